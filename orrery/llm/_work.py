"""Shared helpers of the subpackage: the shared work folder, stored tables, unique names."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of white space that the contracts name: [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session that
    names none (tests) a temporary one, in which it then checkpoints too. On a cluster a temporary
    folder would be each machine's own, so one must be named."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def bounded_batches(spark: SparkSession) -> None:
    """For jobs over long texts: Arrow batches of some 4 MB, so that a Python worker's memory doesn't
    follow the texts' lengths. Queries and the pipeline set it; a caller of the operators may set
    its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tidy(run):
    """A function for mapInArrow that gives what it allocated back to the machine when its task ends: a
    Python worker goes on to other tasks, and what allocators keep adds up beside the executor's heap."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


_FOLDERS: set[str] = set()


def _clear(spark: SparkSession, folder: str) -> None:
    """Delete a session's tables when the program ends; results read them until then. Best effort: a
    driver that is killed leaves its folder, which is named after its application."""
    with contextlib.suppress(Exception):
        if folder.startswith(("/", "file:")):
            shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
        else:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    folder = f"{work_folder(spark)}/orrery-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_clear, spark, folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


#: Parquet looks at a row group's and a page's size after each row, not after a hundred, and ends a group at a few MB.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stored(df: DataFrame, label: str, large_rows: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here, and what
    was shuffled for it is not needed again if an executor is lost. large_rows: rows of some MB, of which writer and
    reader then hold one or two at a time; else a task holds a hundred when it writes and a row group when it reads."""
    path = new_path(df.sparkSession, label)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast only where the counted rows are within limit; else Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


#: A key that more rows than this have is hot.
HOT = 20_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """left, in which a key may be hot, with the columns of right, which has a row a key and in
    column `rows` the number of left's rows of that key. Keys without a row in right get nulls.

    Hot keys are broadcast: there are fewer than left's rows / HOT of them. The others, at most HOT
    rows each, are joined by shuffle (or broadcast, where Spark measures them small)."""
    hot = right.where(F.col(rows) > HOT).drop(rows)
    if hot.isEmpty():
        return left.join(right.drop(rows), keys, "left")
    mark = hot.withColumn("__hot", F.lit(True))
    both = left.join(F.broadcast(mark), keys, "left")
    cold = both.where("__hot is null").select(*left.columns)
    columns = [*left.columns, *(c for c in hot.columns if c not in keys)]
    cold = cold.join(right.where(F.col(rows) <= HOT).drop(rows), keys, "left").select(columns)
    return both.where("__hot").select(columns).unionByName(cold)
