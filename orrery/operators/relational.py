"""Relational pieces that need more than one built-in call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise ValueError that shows a few keys that occur more than once."""
    again = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"keys {list(keys)} repeat: {[tuple(r)[:-1] for r in again]}")


def one_to_one_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    assert_unique(a, keys)
    assert_unique(b, keys)
    return a.join(b, list(keys), how)


def flag_members(df: DataFrame, members: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """df with 1 in `out` where the keys are among members, else 0."""
    hit = members.select(*keys).distinct().withColumn(out, F.lit(1))
    return df.join(hit, list(keys), "left").na.fill(0, [out])


def top_row(df: DataFrame, by: str, keys: Sequence[str], ties: str, largest: bool = True) -> DataFrame:
    """The row of largest (or smallest) `by` of each group, ties to the least `ties`."""
    order = F.desc(by) if largest else F.asc(by)
    w = Window.partitionBy(*keys).orderBy(order, ties)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_k(df: DataFrame, k: int, by: str, keys: Sequence[str], ties: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key in `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def digitize(value: Column, edges: Sequence[float]) -> Column:
    """How many edges lie below the value: bins closed on the right."""
    out = F.lit(0)
    for e in edges:
        out = out + (value > F.lit(float(e))).cast("int")
    return out


def quantile_edges(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, edges): distinct inner quantiles."""
    p = F.percentile(value, F.array(*[F.lit((k + 1) / bins) for k in range(bins - 1)]))
    return df.groupBy(*keys).agg(F.array_distinct(p).alias("edges"))


def bin_by(df: DataFrame, value: str, edges: DataFrame, keys: Sequence[str] = (), out: str = "bin") -> DataFrame:
    rows = df.join(edges, list(keys)) if keys else df.crossJoin(F.broadcast(edges))
    return rows.withColumn(out, F.size(F.filter("edges", lambda e: F.col(value) > e))).drop("edges")


def three_bins(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "bin") -> DataFrame:
    return bin_by(df, value, quantile_edges(df, value, 3, keys), keys, out)


def combined_strata(columns: Sequence[str], sizes: Sequence[int]) -> Column:
    """Several bin numbers as one, the first counting fastest."""
    out, scale = F.lit(0), 1
    for c, n in zip(columns, sizes, strict=True):
        out, scale = out + F.col(c) * scale, scale * n
    return out


def histogram_gap(a: DataFrame, b: DataFrame, bin_col: str = "bin") -> DataFrame:
    """(gap): sum of absolute differences of two histograms over the first one's total."""
    ha, hb = a.groupBy(bin_col).agg(F.count(F.lit(1)).alias("x")), b.groupBy(bin_col).agg(F.count(F.lit(1)).alias("y"))
    rows = ha.join(hb, bin_col, "full")
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return rows.agg((F.sum(F.abs(x - y)) / F.greatest(F.sum(x), F.lit(1))).alias("gap"))


def bin_trend(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slope, delta): positive rate over quartile bins of a score: its slope, and last less first.
    Null under 8 rows or under three distinct cuts."""
    cuts = quantile_edges(df, score, 4, keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rates = bin_by(df, score, cuts, keys).groupBy(*keys, "bin").agg(F.avg(F.col(label).cast("double")).alias("rate"))
    t = rates.groupBy(*keys).agg(F.regr_slope("rate", "bin").alias("s"), (F.max_by("rate", "bin") - F.min_by("rate", "bin")).alias("d"))
    facts = cuts.select(*keys, F.size("edges").alias("c"))
    rows = t.join(n, list(keys)).join(facts, list(keys)) if keys else t.crossJoin(n).crossJoin(facts)
    ok = (F.col("n") >= 8) & (F.col("c") >= 3)
    return rows.select(*keys, F.when(ok, F.col("s")).alias("slope"), F.when(ok, F.col("d")).alias("delta"))


def layer_steps(df: DataFrame, value: str, keys: Sequence[str], order: str = "layer") -> DataFrame:
    """Differences of successive layers, and their size over the node's median size."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("step", F.col(value) - F.lag(value).over(w)).where("step is not null")
    m = rows.groupBy(*keys).agg(F.percentile(F.abs("step"), F.lit(0.5)).alias("__m"))
    return rows.join(m, list(keys)).withColumn("rupture", F.abs("step") / F.greatest("__m", F.lit(1e-9))).drop("__m")


def linear_trend(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))
