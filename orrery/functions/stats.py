"""Grouped statistics over DataFrames: ranks, AUC, correlation, quantiles, tail probabilities.

`keys` are the slice columns: every function gives one row for each slice, or a column computed
inside it. NaN counts as missing. Sorting is per slice; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .expressions import chi2_upper


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """What Spark's round() gives of doubles: halves of the shortest decimal go away from zero. For kernels of very many rows, as it takes
    the decimals of those numbers alone that may be halves."""
    y = x * 10.0**digits
    z = np.rint(y)
    out = z / 10.0**digits
    large = np.abs(y) >= 2.0**40
    at = np.flatnonzero((np.abs(np.abs(y - z) - 0.5) < 1e-3) | large)
    if len(at):
        values, of = np.unique(x[at], return_inverse=True)
        out[at] = np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if np.isfinite(v) and abs(v) < 1e15 else v for v in values.tolist()])[of]
    return out


def missing(c: Column | str) -> Column:
    """NaN as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), None).otherwise(c)


def rank_average(value: str, keys: Sequence[str] = ()) -> Column:
    """Rank from 1, ties sharing the mean of their ranks."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def rank_share(value: str, keys: Sequence[str] = ()) -> Column:
    return rank_average(value, keys) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def rank_bins(value: str, bins: int | Column, keys: Sequence[str] = ()) -> Column:
    """Bins of equal share by average rank, numbered from 0; ties share a bin."""
    q = F.lit(bins) if isinstance(bins, int) else bins
    return F.least(F.floor(rank_share(value, keys) * q), q - 1).cast("int")


def degree_bins(value: str, most: int = 5, keys: Sequence[str] = ()) -> Column:
    """rank_bins with as many bins as the root of the rows in the slice, from 1 to most."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    q = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.sqrt(n)))).cast("int")
    return rank_bins(value, q, keys)


def quantile(value: Column | str, q: float | Sequence[float]) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(value, F.lit(q) if isinstance(q, float) else F.array(*[F.lit(float(x)) for x in q]))


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), out: str = "auc") -> DataFrame:
    """ROC AUC of each slice: rows are first counted by score, so a shuffle moves a row for each
    distinct score and task. Null where a class is missing; 0.5 for a constant score. Rows with a
    missing score are left out."""
    rows = df.where(missing(score).isNotNull() & F.col(label).isNotNull())
    counted = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("__p"), F.count(F.lit(1)).alias("__n"))
    return counted_auc(counted, score, "__p", "__n", keys, out)


def counted_auc(counted: DataFrame, score: str, positive: str, rows: str, keys: Sequence[str] = (), out: str = "auc") -> DataFrame:
    """ROC AUC of each slice from how many rows, and how many positive ones, have each score."""
    w = Window.partitionBy(*keys).orderBy(score)
    others = F.col(rows) - F.col(positive)
    below = F.coalesce(F.sum(others).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counted.withColumn("__w", F.col(positive) * (below + others / 2))
    p, n = F.sum(positive), F.sum(others)
    return wins.groupBy(*keys).agg(F.when((p > 0) & (n > 0), F.sum("__w") / (p * n)).alias(out), p.alias("n_positive"), n.alias("n_negative"))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation, 0 where either side is constant; an aggregate."""
    flat = (F.var_pop(x) <= 1e-18) | (F.var_pop(y) <= 1e-18)
    return F.when(flat, F.lit(0.0)).otherwise(F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y)))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), out: str = "rho") -> DataFrame:
    """Correlation of average ranks over complete rows; null under 3 of them, 0 for a constant."""
    rows = df.where(missing(x).isNotNull() & missing(y).isNotNull())
    ranked = rows.select(*keys, rank_average(x, keys).alias("__x"), rank_average(y, keys).alias("__y"))
    return ranked.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) < 3, None).otherwise(correlation("__x", "__y")).alias(out), F.count(F.lit(1)).alias("n")
    )


def zscore(value: str, keys: Sequence[str] = (), floor: float = 1e-8, sample: bool = False) -> Column:
    """(x - mean) / deviation within the slice; 0 where the deviation is under floor."""
    w = Window.partitionBy(*keys)
    sd = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    return F.when(sd < floor, F.lit(0.0)).otherwise((F.col(value) - F.avg(value).over(w)) / sd)


def upper_tail_p(null: Column, observed: Column) -> Column:
    """(1 + nulls at or above the observed) / (1 + nulls), missing nulls left out; an aggregate."""
    null = missing(null)
    n = F.count(null)
    p = (1 + F.count(F.when(null >= observed, 1))) / (n + 1)
    return F.when((n > 0) & F.first(missing(observed)).isNotNull(), p)


def lower_tail_p(null: Column, observed: Column) -> Column:
    return upper_tail_p(-null, -observed)


def two_sided_p(null: Column, observed: Column) -> Column:
    return upper_tail_p(F.abs(null), F.abs(observed))


def null_summary(df: DataFrame, observed: str, null: str, keys: Sequence[str]) -> DataFrame:
    """Observed value of each slice against its nulls: mean, sample deviation, difference, z, p, 95 % point."""
    o, x = F.first(observed), missing(null)
    sd = F.stddev_samp(x)
    return df.groupBy(*keys).agg(
        o.alias("observed"), F.avg(x).alias("null_mean"), sd.alias("null_sd"), (o - F.avg(x)).alias("delta"),
        F.when(sd > 1e-12, (o - F.avg(x)) / sd).alias("z"), upper_tail_p(F.col(null), F.col(observed)).alias("p_upper"),
        lower_tail_p(F.col(null), F.col(observed)).alias("p_lower"), two_sided_p(F.col(null), F.col(observed)).alias("p_two_sided"),
        F.percentile(x, F.lit(0.95)).alias("q95_null"),
    )


def fisher_stat(p: Column | str) -> Column:
    """Fisher's combination of p values clipped to [1e-12, 1]; an aggregate that skips missing ones."""
    p = missing(p)
    return -2 * F.sum(F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p))))


def fisher_p(p: Column | str) -> Column:
    n = F.count(missing(p))
    return F.when(n > 0, chi2_upper(fisher_stat(p), n))


def r_squared(y: Column, predicted: Column) -> Column:
    """1 - residual / total sum of squares; 0 for a flat y. An aggregate."""
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst <= 1e-12, F.lit(0.0)).otherwise(1 - F.sum((y - predicted) * (y - predicted)) / sst)


def log_loss(label: Column, score: Column, floor: float = 1e-6) -> Column:
    q = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), score))
    return F.avg(-F.when(label > 0, F.ln(q)).otherwise(F.ln(1 - q)))


def brier(label: Column, score: Column) -> Column:
    return F.avg((score - label) * (score - label))


def confusion(label: Column, predicted: Column) -> dict[str, Column]:
    """precision, recall and f1, each 0 where it has no basis."""
    tp = F.sum(F.when((label > 0) & (predicted > 0), 1).otherwise(0))
    fp = F.sum(F.when((label <= 0) & (predicted > 0), 1).otherwise(0))
    fn = F.sum(F.when((label > 0) & (predicted <= 0), 1).otherwise(0))
    zero = F.lit(0.0)
    return {
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero),
        "f1": F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(zero),
    }


def best_f1_threshold(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), steps: int = 37) -> DataFrame:
    """The first of `steps` quantile thresholds, from 5 to 95 %, with the largest F1 of each slice."""
    shares = [0.05 + 0.9 * k / (steps - 1) for k in range(steps)]
    cuts = df.groupBy(*keys).agg(F.percentile(score, F.array(*[F.lit(s) for s in shares])).alias("__cuts"))
    cuts = cuts.select(*keys, F.posexplode("__cuts").alias("__k", "threshold"))
    joined = df.join(cuts, list(keys)) if keys else df.crossJoin(F.broadcast(cuts))
    f1 = confusion(F.col(label), (F.col(score) >= F.col("threshold")).cast("int"))["f1"]
    scored = joined.groupBy(*keys, "__k", "threshold").agg(f1.alias("f1"))
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("__k")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", "b.f1")
