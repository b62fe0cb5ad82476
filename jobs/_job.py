"""What the jobs share: config files, logs, and the command line that alone creates and stops a session."""

from __future__ import annotations

import argparse
import contextlib
import json
import logging
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("orrery.jobs")


def config(name: str, given: Mapping | None = None) -> dict:
    """The settings of a job's file, which lies beside the jobs, with those that are given instead."""
    known = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    if odd := set(given or {}) - set(known):
        raise ValueError(f"{name} has no setting {sorted(odd)}")
    return known | dict(given or {})


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block lasts."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def written(df: DataFrame, path: str, by: list[str], what: str) -> DataFrame:
    """df as Parquet, a folder for each value of `by`; partitions that df has are replaced whole, others stay.
    Returned is what the folder holds then."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    log.info("wrote %s: %d rows in %s", what, back.count(), path)
    return back


def main(name: str, run: Callable, paths: list[str], argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=run.__doc__)
    for x in paths:
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--config", help="a JSON file whose settings replace those of the job's own")
    a = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        given = json.loads("".join(r.value for r in spark.read.text(c, wholetext=True).collect())) if (c := a.pop("config")) else None
        run(spark, **{k: a[k] for k in paths}, settings=given)
    finally:
        spark.stop()
