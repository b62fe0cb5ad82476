"""What goes into a slice: nodes, their symbols, splits, tiers, matched controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import random as R
from .graph import numbered, top_nodes


def phase(layer: Column, n_layers: int) -> Column:
    """early, mid or late third of the depth."""
    return F.when(layer < n_layers / 3, "early").when(layer < 2 * n_layers / 3, "mid").otherwise("late")


def neighbour_bucket(k: Column) -> Column:
    return F.when(k <= 20, "k<=20").when(k <= 30, "k21-30").otherwise("k>30")


def mapped_nodes(edges: DataFrame, cap: int, node: str = "source", token: str = "token") -> DataFrame:
    """(node, token, degree): the cap nodes of most rows, each with its commonest token, ties to the least."""
    counts = edges.groupBy(F.col(node).alias("node"), F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("node").orderBy(F.desc("n"), "token")
    best = counts.withColumn("r", F.row_number().over(w)).withColumn("degree", F.sum("n").over(Window.partitionBy("node"))).where("r = 1")
    return best.orderBy(F.desc("degree"), "node").limit(cap).select("node", "token", "degree")


def symbol_map(edges: DataFrame) -> DataFrame:
    """(node, symbol) of (source_id, source, target_id, target): targets' names win over sources'."""
    one = edges.select(F.col("source_id").alias("node"), F.upper("source").alias("symbol"), F.lit(0).alias("p"))
    two = edges.select(F.col("target_id").alias("node"), F.upper("target").alias("symbol"), F.lit(1).alias("p"))
    return one.unionByName(two).groupBy("node").agg(F.max_by("symbol", F.struct("p", "symbol")).alias("symbol"))


def first_seen(rows: DataFrame, symbol: str, node: str, order: str) -> DataFrame:
    """(symbol, node, degree): the node first seen under each symbol, and how often the symbol occurs."""
    return rows.groupBy(F.upper(symbol).alias("symbol")).agg(F.min_by(node, order).alias("node"), F.count(F.lit(1)).alias("degree"))


def positions(nodes: DataFrame, column: str = "node") -> DataFrame:
    """Distinct nodes with their position from 0, in order."""
    return numbered(nodes.select(column).distinct(), column, "pos")


def edges_within(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with both ends among the nodes, with their positions."""
    p = positions(nodes)
    a = p.select(F.col("node").alias(source), F.col("pos").alias("source_pos"))
    b = p.select(F.col("node").alias(target), F.col("pos").alias("target_pos"))
    return edges.join(a, source).join(b, target)


def quantile_masks(df: DataFrame, value: str, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """df with is_low and is_high; neither holds in a slice under 10 rows."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("q"), F.count(F.lit(1)).alias("qn"))
    rows = df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))
    ok = F.col("qn") >= 10
    return rows.withColumn("is_low", ok & (F.col(value) <= F.col("q")[0])).withColumn("is_high", ok & (F.col(value) >= F.col("q")[1])).drop("q", "qn")


def class_counts(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    pos = F.sum(F.when(F.col(label) > 0, 1).otherwise(0))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n"), pos.alias("n_positive"), F.least(pos, n - pos).alias("min_class"))


def matched_controls(df: DataFrame, hot: str, row: str, bin_col: str, label: str, salt: str = "control") -> DataFrame:
    """(hot row, control row): for each hot row another one of its bin and label, else of its bin, else any;
    hot and cold rows are numbered by hash within the tier and met on the number, so no tier is paired in full."""
    hots, colds = df.where(F.col(hot)), df.where(~F.col(hot))
    out, left = None, hots.select(F.col(row).alias("hot"), bin_col, label)
    for tier in ([bin_col, label], [bin_col], []):
        cold = colds.select(*tier, F.col(row).alias("control"), (F.row_number().over(Window.partitionBy(*tier).orderBy(R.key(row, salt=salt), row)) - 1).alias("at"))
        size = cold.groupBy(*tier).agg(F.count(F.lit(1)).alias("size"))
        sized = left.join(size, tier) if tier else left.crossJoin(size)
        drawn = sized.where("size > 0").withColumn("at", R.number("hot", salt=salt + str(len(tier))) % F.col("size"))
        got = drawn.join(cold, [*tier, "at"]).select("hot", "control", F.lit(len(tier)).alias("tier"))
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("hot"), "hot", "left_anti")
    return out


def redrawn_targets(edges: DataFrame, nodes: DataFrame, salt: str = "redraw") -> DataFrame:
    """Edges whose target is their source get another by hash."""
    p = positions(nodes)
    n = p.agg(F.count(F.lit(1)).alias("n"))
    own = p.select(F.col("node").alias("source"), F.col("pos").alias("sp"))
    rows = edges.join(own, "source").crossJoin(F.broadcast(n))
    to = (F.col("sp") + 1 + R.number("source", salt=salt) % (F.col("n") - 1)) % F.col("n")
    aimed = rows.withColumn("to", to).join(p.select(F.col("pos").alias("to"), F.col("node").alias("drawn")), "to")
    return aimed.withColumn("target", F.when(F.col("target") == F.col("source"), F.col("drawn")).otherwise(F.col("target"))).drop("sp", "n", "to", "drawn")


def density_tiers(scores: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, density, tier): mean score to all other symbols, absent pairs as 0, in thirds."""
    n = symbols.select("symbol").distinct().agg(F.count(F.lit(1)).alias("n"))
    inside = scores.join(symbols.select(F.col("symbol").alias("a")), "a").join(symbols.select(F.col("symbol").alias("b")), "b").where("a <> b")
    s = inside.groupBy(F.col("a").alias("symbol")).agg(F.sum("score").alias("s"))
    rows = symbols.select("symbol").distinct().join(s, "symbol", "left").crossJoin(F.broadcast(n))
    d = rows.select("symbol", (F.coalesce("s", F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("density"))
    cut = d.agg(F.percentile("density", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    tier = F.when(F.col("density") <= F.col("c")[0], "low").when(F.col("density") >= F.col("c")[1], "high").otherwise("mid")
    return d.crossJoin(F.broadcast(cut)).select("symbol", "density", tier.alias("tier"))


def best_and_worst_layer(df: DataFrame, value: str, key: str, layer: str = "layer") -> DataFrame:
    m = df.groupBy(key, layer).agg(F.avg(value).alias("m"))
    return m.groupBy(key).agg(F.max_by(layer, F.struct("m", -F.col(layer))).alias("best_layer"), F.min_by(layer, F.struct("m", layer)).alias("worst_layer"))


def bundle(edges: DataFrame, cap: int, sample: int, label: str = "label", least_nodes: int = 120, least_rows: int = 120, salt: str = "bundle") -> DataFrame:
    """The edges of one slice: among its top nodes, sampled by class; none where a class, nodes or rows are
    too few. Guards are part of the plan, so an empty slice is an empty table."""
    nodes = top_nodes(edges, cap)
    inside = edges_within(edges, nodes.select("node"))
    keyed = inside.withColumn("__row", F.concat_ws("-", F.col("source").cast("string"), F.col("target").cast("string")))
    drawn = R.stratified_sample(keyed, sample, "__row", salt, label).drop("__row")
    facts = drawn.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("classes"))
    size = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    ok = drawn.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(size)).where((F.col("rows") >= least_rows) & (F.col("classes") >= 2) & (F.col("nodes") >= least_nodes))
    return ok.drop("rows", "classes", "nodes")


def adaptive_k(points: DataFrame, keys: Sequence[str], neighbours: DataFrame, low: int = 8, high: int = 20) -> DataFrame:
    """(keys, k): 14, less 10 times the variation of the 7th neighbour's distance, more with the points."""
    seventh = neighbours.where("rank = 7").groupBy(*keys).agg((F.stddev_pop("distance") / F.greatest(F.avg("distance"), F.lit(1e-12))).alias("cv"))
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    k = F.round(14 - 10 * F.col("cv") + 2 * (F.col("n") - 160) / 80)
    return seventh.join(n, list(keys)).select(*keys, F.greatest(F.lit(low), F.least(F.lit(high), k)).cast("int").alias("k"))


