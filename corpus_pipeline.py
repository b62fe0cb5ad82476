"""A corpus pipeline over documents: each stage takes (spark, docs, sf_dir) and returns what it keeps.

Stages: quality classifier, line dedup, SimHash near-dedup, mixing to target weights, packing. All
but the last return the columns of documents. A stage's result is written to the shared folder and
read again as the next one's input.

Null and empty texts are texts without words, lines or tokens: they are scored by the classifier's
bias, keep their one empty line, are near copies of each other, weigh nothing in the mix and are
packed as an end token. Rows without an id or source, and rows that repeat one, go through as rows
of their own; near_dedup alone leaves one of a repeated row. Ties fall by id, then by text. Empty
tables stay empty, extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import classifier, copies, lines, mixing, packing
from orrery.llm._work import bounded_batches, stored
from orrery.llm.queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, scores 0.5 or more stay; where no label can
    be learnt from, all score 0.5 and stay."""
    model = classifier.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return classifier.score(docs, model, out="__score").where("__score >= 0.5").drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from all documents but the last that holds them; every document stays."""
    bounded_batches(spark)
    cleaned = lines.dedup_lines(docs)
    return cleaned.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id. Near are texts
    whose sets of five-word shingles have a cosine of 0.8 or more, which any at a Jaccard similarity
    of 0.8 have."""
    bounded_batches(spark)
    return copies.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as their source's rate says; those of a source without words go, as its rate is 0."""
    return mixing.emit(mixing.mix(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 4096; each row is a document of its own, whatever its id."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer=tokenizer_path(), end=2)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_sources),
    ("packing", pack),
]

#: Training and packing have no counterpart in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
