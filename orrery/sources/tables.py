"""Readers, writers and the views of the driver tables that the queries work on."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def aligned_unions(spark: SparkSession) -> None:
    """Spark 4.1 takes a union of tables that are partitioned alike to be partitioned so too, though adaptive
    execution may coalesce each on its own: a group's rows are then in two tasks, and a grouped or cogrouped
    kernel over them is wrong now and then. Switched off, such a union is shuffled again."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    aligned_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# readers and writers


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file with a declared schema, so that nothing is inferred in a first pass."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, nullValue="", nanValue="nan")


def read_json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON documents, with the file they come from."""
    reader = spark.read.option("multiLine", True)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    return df.withColumn("file", F.col("_metadata.file_path"))


def append_events(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to what is there."""
    df.write.mode("append").json(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def write_json_document(spark: SparkSession, path: str, payload: dict) -> None:
    """One sorted, indented JSON document through Spark, so that any store will do."""
    text = json.dumps(payload, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_tensor(spark: SparkSession, path: str, dims: Sequence[str] = ("layer", "node_id")) -> DataFrame:
    """Rows (layer, node_id, vec) of .npy tensors of float[layers, nodes, d], a row per vector. Files are read
    by the executors; each must fit a task, as one file per domain and seed does."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for path_, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                t = np.load(io.BytesIO(raw), allow_pickle=False).astype(np.float64)
                for layer, rows in enumerate(t):
                    n = len(rows)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path_] * n), pa.array([layer] * n, pa.int32()), pa.array(np.arange(n)), vec], ["file", *dims, "vec"]
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, {dims[0]} int, {dims[1]} long, vec array<double>")


def require_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raise FileNotFoundError that names every path that isn't there, on any store Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    absent = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(conf).exists(at):
            absent.append(p)
    if absent:
        raise FileNotFoundError("missing inputs: " + ", ".join(absent))


# annotation tables


def confidence_scores(raw: DataFrame, unknown: int = 0) -> DataFrame:
    """(source, target, score): upper-cased pairs, grades A to E as 4 to 0, the best of repeats."""
    grade = F.upper(F.trim("confidence"))
    score = F.when(grade.isin(list("ABCDE")), F.lit(4) - (F.ascii(grade) - 65)).otherwise(F.lit(unknown))
    return raw.groupBy(F.upper("source").alias("source"), F.upper("target").alias("target")).agg(F.max(score).alias("score"))


def signed_pairs(raw: DataFrame, order: str) -> DataFrame:
    """(source, target, sign): activation 1, repression -1, others left out; the first row wins."""
    mode = F.lower("mode")
    sign = F.when(mode.startswith("activation"), 1).when(mode.startswith("repression"), -1)
    rows = raw.withColumn("sign", sign).where("sign is not null")
    return rows.groupBy(F.upper("source").alias("source"), F.upper("target").alias("target")).agg(F.min_by("sign", order).alias("sign"))


def source_degree(raw: DataFrame) -> DataFrame:
    """Rows, repeats counted, of each source."""
    return raw.groupBy(F.upper("source").alias("source")).agg(F.count(F.lit(1)).alias("degree"))


def symmetric_scores(raw: DataFrame) -> DataFrame:
    """(a, b, score) in both directions, clipped to [0, 1], the best of repeats; missing ones left out."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    rows = raw.where(F.col("score").isNotNull() & ~F.isnan("score")).select(F.upper("a").alias("a"), F.upper("b").alias("b"), s.alias("score"))
    both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    return both.groupBy("a", "b").agg(F.max("score").alias("score"))


def term_sets(pairs: DataFrame, prefix: str | None = None) -> DataFrame:
    """(symbol, term), distinct, upper-cased symbols, only terms with the prefix."""
    rows = pairs.select(F.upper("symbol").alias("symbol"), "term")
    return (rows.where(F.col("term").startswith(prefix)) if prefix else rows).distinct()


def targets_of(pairs: DataFrame) -> DataFrame:
    """Sources with the sorted set of their targets."""
    return pairs.groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("targets"))


# views of the driver tables


def points(spark: SparkSession, sf_dir: str, layers: int = 4, width: int = 16) -> DataFrame:
    """(vec_id, label, domain, layer, vec): each embedding cut into layers, as doubles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    cut = F.array(*[F.slice("e", 1 + width * k, width) for k in range(layers)])
    return e.select("vec_id", "label", (F.col("label") % 3).alias("domain"), F.posexplode(cut).alias("layer", "vec"))


def whole_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, w): lines ordered by customers of a nation from suppliers of another, by
    nation key. Lines are summed per (customer nation, supplier) side before the last join."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    orders = t("orders").select("o_orderkey", "o_custkey")
    customers = t("customer").select("c_custkey", F.col("c_nationkey").alias("source"))
    suppliers = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("target"))
    by_supplier = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("source", "l_suppkey").agg(F.sum("n").alias("n"))
    )
    return by_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("source", "target").agg(F.sum("n").alias("w"))


def trade_top(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """The k heaviest targets of each source, ties by id, loops left out."""
    w = Window.partitionBy("source").orderBy(F.desc("w"), "target")
    rows = trade(spark, sf_dir).where("source <> target")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def customer_brands(spark: SparkSession, sf_dir: str, top: int = 6) -> DataFrame:
    """(symbol, term): a supplier and the part types that it delivers most."""
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").select("l_suppkey", "l_partkey")  # hardly any pair is there twice, so lines are summed by brand alone
    by_type = sold.join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "p_brand")
    return by_type.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).select(F.col("l_suppkey").alias("symbol"), F.col("p_brand").alias("term"))


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pos, token): each user's events in order of time and id."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return e.select("user_id", F.row_number().over(w).alias("pos"), F.col("event_type").alias("token"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, quality, toxic) of the labelled documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id")


def unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("vec", X.unit("vec"))
