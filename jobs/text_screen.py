"""Incremental screen of texts: which properties of a text tell labelled documents apart, by language and
half, and do they beat every null family?

    python -m jobs.text_screen --documents .../documents.parquet --labels .../labels.parquet --out .../screen --checkpoint .../mark

The folder of documents is a file stream: a run takes the files that no run before has taken, measures
their texts and appends (doc_id, lang, source, half, measures) by language; texts are read once. Then labels
are joined to all measures, whenever they came, and `nulls` and `results` are written anew by hypothesis.
A run without new files measures nothing and gives the same results. The checkpoint is the mark; it belongs
to `out`, and both go together.

Null and empty texts have no words: their length is 0, their other measures are null. A document whose id
repeats counts once for each row, and once for each of its labels. Rows without a label are not in a slice.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._job import config, log, main, setting, written
from orrery.functions import random as R
from orrery.operators import graph
from orrery.plans import draws

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string"
KEYS = ["lang", "half"]


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Integers: words, hundredths of a character a word, and per mille of distinct words, digits and symbols."""
    n, chars = F.size(words), F.length(F.array_join(words, ""))
    held = lambda c: F.when(n > 0, c)
    share = lambda part, of: F.floor(1000 * part / of)
    return {
        "words": n.cast("long"),
        "word_length": held(F.floor(100 * chars / n)),
        "distinct_words": held(share(F.size(F.array_distinct(words)), n)),
        "digits": held(share(F.length(F.regexp_replace(text, "[^0-9]", "")), chars)),
        "symbols": held(share(F.length(F.regexp_replace(text, r"[^#*$%&|<>]", "")), chars)),
    }


NAMES = ("words", "word_length", "distinct_words", "digits", "symbols")


def measured(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", "lang", "source", (R.number("doc_id", salt="half") % 2).cast("int").alias("half"), text.alias("text"))
    rows = rows.withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return rows.select("doc_id", "source", "half", *[c.cast("long").alias(m) for m, c in measures(F.col("text"), F.col("w")).items()], "lang")


def _pattern(path: str) -> str:
    """A path as a pattern that it alone fits: as such, one file streams as a folder of files does."""
    path = path.rstrip("/")
    return path if re.search(r"[*?\[{]", path) else f"{path[:-1]}[{path[-1]}]"


def _known(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """All measures so far; none where no file has been there to take."""
    try:
        return spark.read.schema(kinds).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)


def run(spark: SparkSession, documents: str, labels: str, out: str, checkpoint: str, settings: Mapping | None = None) -> DataFrame:
    """Take the new files of a folder of documents and screen all that have been taken; returns the results, read back."""
    s = config("text_screen", settings)
    graph.checkpoints(spark)
    with setting(spark, "spark.sql.unionOutputPartitioning", "false"):
        new = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(_pattern(documents))
        stream = measured(new).writeStream.format("parquet").option("path", f"{out}/measures").option("checkpointLocation", checkpoint)
        query = stream.partitionBy("lang").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        log.info("read %s: %d new documents in %d batches", documents, sum(p.numInputRows for p in query.recentProgress), sum(p.numInputRows > 0 for p in query.recentProgress))
        kinds = f"doc_id long, source string, half int, {', '.join(f'{m} long' for m in NAMES)}, lang string"
        known = _known(spark, f"{out}/measures", kinds)
        marks = spark.read.parquet(labels).select("doc_id", F.col(s["label"]).alias("y"))
        rows = known.join(marks, "doc_id").checkpoint()
        log.info("measured so far: %d documents; labelled rows: %d", known.count(), rows.count())
        seen, nulls = draws.drawn_screen(rows, "doc_id", "y", {m: F.col(m) for m in NAMES}, KEYS, "source", s["replicates"])
        nulls = written(nulls, f"{out}/nulls", ["hypothesis"], "null values")
        return written(draws.verdicts(seen, nulls, KEYS), f"{out}/results", ["hypothesis"], "results")


if __name__ == "__main__":
    main("text_screen", run, ["documents", "labels", "out", "checkpoint"])
