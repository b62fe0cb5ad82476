"""Result and null tables: calibration of a score against null families, strict audits, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fisher_p, missing, upper_tail_p


def q95(value: str) -> Column:
    return F.percentile(missing(value), F.lit(0.95))


def pooled_gap(results: DataFrame, nulls: DataFrame, keys: Sequence[str], observed: str = "delta", null: str = "null_value") -> DataFrame:
    """results with q95_null, over all null kinds together, and the observed value's gap to it."""
    q = nulls.groupBy(*keys).agg(q95(null).alias("q95_null"))
    return results.join(q, list(keys), "left").withColumn("null_gap", F.col(observed) - F.col("q95_null"))


def tail_by_kind(results: DataFrame, nulls: DataFrame, keys: Sequence[str], observed: str = "delta", null: str = "null_value") -> DataFrame:
    """(keys, null_kind, p_upper) of each null kind, and p_best: the largest over the kinds."""
    rows = nulls.join(results.select(*keys, observed), list(keys))
    return rows.groupBy(*keys, "null_kind").agg(upper_tail_p(F.col(null), F.col(observed)).alias("p_upper"))


def strict_audit(results: DataFrame, nulls: DataFrame, keys: Sequence[str], kinds: Sequence[str], observed: str = "delta", null: str = "null_value") -> DataFrame:
    """results with q95 and mean of each null kind, the margin to each, and the margin to the largest q95:
    a result is strictly positive only if it beats every null family."""
    wide = nulls.groupBy(*keys).pivot("null_kind", list(kinds)).agg(q95(null).alias("q95"), F.avg(missing(null)).alias("mean"))
    out = results.join(wide, list(keys), "left")
    cuts = [F.col(f"{k}_q95") for k in kinds]
    for k in kinds:
        out = out.withColumn(f"margin_vs_{k}", F.col(observed) - F.col(f"{k}_q95"))
    top = F.greatest(*cuts) if len(cuts) > 1 else cuts[0]
    return out.withColumn("strict_q95_max", top).withColumn("strict_margin", F.col(observed) - top).withColumn("strict_positive", (F.col(observed) > top).cast("int"))


def summary(df: DataFrame, keys: Sequence[str], delta: str = "delta", gap: str = "null_gap", p: str = "p_upper") -> DataFrame:
    """Mean delta and gap, shares of positive ones and Fisher's p of each group of slices."""
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(missing(delta)).alias("mean_delta"), F.avg(missing(gap)).alias("mean_gap"),
        share(delta).alias("share_delta_positive"), share(gap).alias("share_gap_positive"), fisher_p(p).alias("fisher_p"),
    )


def two_level_summary(df: DataFrame, outer: str, inner: str, **columns: str) -> DataFrame:
    """summary() by both keys and by the outer alone, in one pass: inner is null in the outer's rows."""
    delta, gap, p = columns.get("delta", "delta"), columns.get("gap", "null_gap"), columns.get("p", "p_upper")
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return df.groupingSets([[F.col(outer), F.col(inner)], [F.col(outer)]], outer, inner).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(missing(delta)).alias("mean_delta"), F.avg(missing(gap)).alias("mean_gap"),
        share(delta).alias("share_delta_positive"), share(gap).alias("share_gap_positive"), fisher_p(p).alias("fisher_p"),
    )


def box_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Least, quartiles and largest of a value, as a box plot shows them."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("low", "q25", "median", "q75", "high")
    g = df.groupBy(*keys).agg(p.alias("p"), F.count(value).alias("n"))
    return g.select(*keys, "n", *[F.col("p")[i].alias(c) for i, c in enumerate(names)])


def box_panels(df: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, panel, least, q25, median, q75, most): boxes of several values, a panel each."""
    long = df.select(*keys, F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("i", "x"))
    panel = F.array(*[F.lit(v) for v in values])[F.col("i")]
    b = box_stats(long.select(*keys, panel.alias("panel"), "x"), "x", [*keys, "panel"])
    return b.select(*keys, "panel", F.col("low").alias("least"), "q25", "median", "q75", F.col("high").alias("most"))


def observed_and_null(df: DataFrame, measures: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """(keys, measure, observed, null_mean): means of measures beside those of their null columns, as
    bars with a line show them."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), missing(m).alias("o"), missing(n).alias("x")) for m, n in measures.items()]))
    long = df.select(*keys, each.alias("e"))
    return long.groupBy(*keys, F.col("e.measure").alias("measure")).agg(F.avg("e.o").alias("observed"), F.avg("e.x").alias("null_mean"))


def layer_bars(df: DataFrame, p: str = "p_upper", floor: float = 1e-10) -> DataFrame:
    """Rows with -log10 p for bars, and a flag for p under 5 %."""
    return df.withColumn("minus_log10_p", -F.log10(F.greatest(F.col(p), F.lit(floor)))).withColumn("significant", (F.col(p) < 0.05).cast("int"))


def decision_history(screens: DataFrame, last: int = 8, lines: int = 24) -> tuple[DataFrame, DataFrame]:
    """From (iteration, id, family, decision): the newest rows of the last iterations, and the families with
    two or more negative or inconclusive decisions in them."""
    newest = screens.select("iteration").distinct().orderBy(F.desc("iteration")).limit(last)
    rows = screens.join(F.broadcast(newest), "iteration")
    shown = rows.orderBy(F.desc("iteration"), "id").limit(lines)
    weak = rows.where(F.col("decision").isin("negative", "inconclusive")).groupBy("family").agg(F.count(F.lit(1)).alias("n_weak")).where("n_weak >= 2")
    return shown, weak


def explode_screens(documents: DataFrame) -> DataFrame:
    """Hypothesis rows of screen documents {hypotheses: [...]}, with the iteration from the file's name."""
    h = documents.select(F.regexp_extract("file", r"iter_(\d+)", 1).cast("int").alias("iteration"), F.explode("hypotheses").alias("h"))
    return h.select("iteration", "h.*")


def next_iteration(names: DataFrame, column: str = "name") -> DataFrame:
    n = F.max(F.regexp_extract(column, r"^iter_(\d+)$", 1).try_cast("int"))
    return names.agg((F.coalesce(n, F.lit(0)) + 1).alias("next_iteration"))


def gate(df: DataFrame, checks: Sequence[str]) -> DataFrame:
    """df with the names of the boolean columns that fail (null fails), and whether none does."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), None).otherwise(F.lit(c)) for c in checks]))
    return df.withColumn("failed_checks", failed).withColumn("passed", F.size("failed_checks") == 0)
