"""Screens whose nulls draw labels instead of permuting them: nothing is sorted or moved for a replicate.

A label is drawn anew for each row and replicate with the rate of the row's slice (label_draw), or of
its stratum in the slice (stratum_draw). Scores lie on a grid of integers, so all that is shuffled are
counts by slice, hypothesis, replicate and grid point, summed where the rows are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import random as R
from ..functions.stats import counted_auc

KINDS = ("label_draw", "stratum_draw")


def drawn_screen(rows: DataFrame, row: str, label: str, scores: Mapping[str, Column], keys: Sequence[str], stratum: str, replicates: int) -> tuple[DataFrame, DataFrame]:
    """results (keys, hypothesis, auc, delta, n_positive, n_negative) and nulls (keys, hypothesis, null_kind, perm_idx,
    null_value) of integer scores by name. A delta, and a null's value, is the distance of an AUC from 0.5,
    for a hypothesis names no direction. Rows without a label are left out, null scores in their hypothesis."""
    each = F.array(*[F.struct(F.lit(h).alias("hypothesis"), s.cast("long").alias("score")) for h, s in scores.items()])
    base = rows.where(F.col(label).isNotNull()).select(*keys, F.col(stratum).alias("__s"), F.col(row).alias("__row"), (F.col(label) > 0).cast("int").alias("__y"), each.alias("__each"))
    rates = base.groupBy(*keys, "__s").agg(F.sum("__y").alias("__ps"), F.count(F.lit(1)).alias("__ns"))
    whole = rates.groupBy(*keys).agg(F.sum("__ps").alias("__p"), F.sum("__ns").alias("__n"))
    same = lambda a, b, on: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in on]
    both = rates.alias("r").join(whole.alias("w"), _all(same("r", "w", keys))).select(*[F.col(f"r.{k}") for k in [*keys, "__s"]], (F.col("__ps") / F.col("__ns")).alias("__rs"), (F.col("__p") / F.col("__n")).alias("__r"))
    known = base.alias("b").join(both.alias("r"), _all(same("b", "r", [*keys, "__s"]))).select(*[F.col(f"b.{k}") for k in keys], "__row", "__y", "__each", "__r", "__rs")
    many = known.withColumn("perm_idx", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    drawn = [F.when(F.col("perm_idx") < 0, F.col("__y")).otherwise((R.uniform("__row", "perm_idx", salt=k) < F.col(r)).cast("int")).alias(k) for k, r in zip(KINDS, ("__r", "__rs"), strict=True)]
    long = many.select(*keys, "perm_idx", *drawn, F.explode("__each").alias("e")).select(*keys, "perm_idx", *KINDS, "e.*").where("score is not null")
    by = [*keys, "hypothesis", "perm_idx"]
    counted = long.groupBy(*by, "score").agg(*[F.sum(k).alias(k) for k in KINDS], F.count(F.lit(1)).alias("__n"))
    side = counted.select(*by, "score", "__n", F.explode(F.array(*[F.struct(F.lit(k).alias("null_kind"), F.col(k).alias("__p")) for k in KINDS])).alias("k")).select(*by, "score", "__n", "k.*")
    scored = counted_auc(side, "score", "__p", "__n", [*by, "null_kind"]).withColumn("delta", F.abs(F.col("auc") - 0.5))
    results = scored.where(f"perm_idx < 0 and null_kind = '{KINDS[0]}'").select(*keys, "hypothesis", "auc", "delta", "n_positive", "n_negative")
    return results, scored.where("perm_idx >= 0").select(*keys, "hypothesis", "null_kind", "perm_idx", F.col("delta").alias("null_value"))


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def verdicts(results: DataFrame, nulls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """results with the q95 of each null family, the share of all null values that reach delta (one added to
    both, so that it is never 0) and strict_positive: 1 where delta beats the larger q95, by more than rounding. Slices with
    one class have a null auc and are not positive."""
    on = [*keys, "hypothesis"]
    same = _all([F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in on])
    cuts = nulls.groupBy(*on).agg(*[q95_of(k).alias(f"{k}_q95") for k in KINDS])
    wide = results.alias("r").join(cuts.alias("n"), same, "left").select("r.*", *[f"n.{k}_q95" for k in KINDS])
    reach = nulls.alias("n").join(results.alias("r"), same).groupBy(*[F.col(f"r.{k}").alias(k) for k in on])
    tail = reach.agg(((1 + F.count_if(F.col("null_value") >= F.col("delta"))) / (1 + F.count("null_value"))).alias("p_upper"))
    joined = wide.alias("r").join(tail.alias("n"), same, "left").select("r.*", "n.p_upper")
    margin = F.col("delta") - F.greatest(*[f"{k}_q95" for k in KINDS])
    return joined.withColumn("strict_margin", margin).withColumn("strict_positive", F.coalesce((margin > 1e-9).cast("int"), F.lit(0)))


def q95_of(kind: str) -> Column:
    return F.percentile(F.when(F.col("null_kind") == kind, F.col("null_value")), F.lit(0.95))
