"""Mixing sources to target weights.

Words are summed per source, the target words of each source follow from the weights by water
filling, and each document is emitted floor(rate) times plus one copy drawn by a Bernoulli trial with
the fraction as its probability, whose random number is a hash of the seed and the document's id.

Trials of a small source may leave its words far from its target. So they are tried again, up to
`TRIES` times, and a source keeps the first try whose words are within `NEAR` of its target, or the
nearest. A document's number moves on from try to try by a step that is another part of its hash. Large
sources keep an early try; the fewer and the more unequal a source's documents, the more its choice of
a try ties their copies to each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import WORD, join_counted, stored

#: A source table of at most so many rows is broadcast, a larger one joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Tries of a source's trials, and how many one pass over the documents adds up.
TRIES, PASS = 256, 16
#: A try within this share of the target is near enough.
NEAR = 0.02


def word_count(text: str | Column = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


#: Bits of a document's random number.
BITS = 52


def draw(key: Column, seed: int) -> tuple[Column, Column]:
    """Two longs of 52 bits of MD5 of key and seed, the second odd; the same in every run and engine. Null keys
    draw alike."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    number = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("long")
    return number(1), number(14).bitwiseOR(F.lit(1))


def taken(x: Column, step: Column, trial: Column, fraction: Column) -> Column:
    """Whether a document's trial of that number succeeds."""
    number = (x + trial * step).bitwiseAND(F.lit((1 << BITS) - 1))
    return number < fraction * F.lit(float(1 << BITS))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """From rows (source, size) the table (source, source_size, rows, weight, target).

    Sources in code-point order, null last, take the weights in turn. The targets share
    `share` times all words by weight; a target stops at `most` times its source's size and the
    excess is shared again among the rest. Nothing is collected but a few sums: the ranks come
    from a range partitioning, the common level from one aggregate a round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ordered = (
        totals.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("at", F.monotonically_increasing_id())
    )
    ordered = stored(ordered, "sources")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a partition
    before, pairs = 0, []
    for r in counts:
        pairs += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    offset = F.create_map(*pairs)[part] if pairs else F.lit(0)
    rank = (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + offset) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    ranked = ordered.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ranked = stored(ranked.select("source", "source_size", "rows", "weight", "cap"), "ranked")

    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        row = ranked.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("c"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["w"]:
            break
        capped, level = row["n"], (share * total - row["c"]) / row["w"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", "rows", "weight", target.alias("target"))


def _keyed(c: str) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias("__mix_key"), F.col(c).isNull().alias("__mix_null")]


KEYS = ["__mix_key", "__mix_null"]


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (with KEYS) and the columns of sources (with KEYS and rows). A table of many sources is
    joined by shuffle, but for the large ones."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources.drop("rows")), KEYS)
    return join_counted(rows, sources, KEYS, "rows")


def tries(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """KEYS and trial: from rows (KEYS, x, step, size) and sources (KEYS, rows, source_size, target, whole, fraction) the
    first trial within NEAR of each source's target, or the nearest. A pass adds up PASS trials of those
    sources that have none yet."""
    open_ = stored(sources.withColumn("best", F.lit(None).cast("struct<gap:double,trial:bigint>")), "mix-open")
    done = []
    for first in range(0, TRIES, PASS):
        rows = _with_sources(drawn, open_.select(*KEYS, "rows", "fraction"))
        sums = rows.groupBy(*KEYS).agg(*[F.sum(F.when(taken(F.col("x"), F.col("step"), F.lit(first + r), F.col("fraction")), F.col("size")).otherwise(0)).alias(f"t{r}") for r in range(PASS)])
        gap = lambda r: F.abs(F.col("whole") * F.col("source_size") + F.col(f"t{r}") - F.col("target"))
        new = F.array(*[F.struct(gap(r).alias("gap"), F.lit(first + r).cast("long").alias("trial")) for r in range(PASS)])
        near = F.get(F.filter(new, lambda t: t["gap"] <= NEAR * F.col("target")), 0)
        best = F.array_min(F.array_compact(F.concat(F.array("best"), new)))
        seen = stored(open_.join(sums, KEYS).select(*[c for c in open_.columns if c != "best"], near.alias("near"), best.alias("best")), "mix-tries")
        done.append(seen.where("near is not null").select(*KEYS, F.col("near.trial").alias("trial")))
        open_ = seen.where("near is null").drop("near")
        if open_.isEmpty():
            break
    done.append(open_.select(*KEYS, F.col("best.trial").alias("trial")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies.

    A null text has no words; a null source is a source of its own, the last. Rows of one id draw
    the same random number, so repeated rows are taken alike, and so are rows without an id. A
    source without words has target 0 and copies 0. Input columns of these four names are replaced;
    an empty table gives an empty table.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    names = docs.columns
    x, step = draw(F.col(id_col), seed)
    drawn = docs.select(F.col(source_col).alias("source"), *_keyed(source_col), word_count(text_col).alias("size"), x.alias("x"), step.alias("step"))
    drawn = stored(drawn, "mix-drawn")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = source_targets(drawn.select("source", "size"), weights, share, most)
    targets = targets.select(*_keyed("source"), "rows", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("fraction"))
    targets = stored(targets, "mix-targets")
    found = targets.join(tries(drawn.drop("source"), targets), KEYS)
    right = stored(found.select(*KEYS, "rows", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "whole", "fraction", "trial"), "mix-sources")
    sized = docs.select("*", word_count(text_col).alias("mix_size"), *_keyed(source_col), x.alias("__mix_x"), step.alias("__mix_step"))
    sized = _with_sources(sized, right.withColumnsRenamed({c: f"__mix_{c}" for c in ("whole", "fraction", "trial")}))
    again = taken(F.col("__mix_x"), F.col("__mix_step"), F.col("__mix_trial"), F.col("__mix_fraction")).cast("long")
    return sized.select(*names, "mix_size", "mix_source_size", "mix_target", (F.col("__mix_whole") + again).cast("long").alias("mix_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as mix_copies says; the mix_ columns are dropped."""
    repeated = mixed.where("mix_copies > 0").withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
    return repeated.drop("__mix_n", "mix_size", "mix_source_size", "mix_target", "mix_copies")
