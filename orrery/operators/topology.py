"""Filtrations of distance tables: components and cycle ranks over grids of thresholds. All thresholds of
all slices go through the same rounds, with the threshold as one more key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rank_share
from .graph import components, cycle_rank


def thresholds(pairs: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = (), name: str = "level") -> DataFrame:
    """(keys, level, cut): quantiles of value in each slice, numbered."""
    q = pairs.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares])).alias("q"))
    return q.select(*keys, F.posexplode("q").alias(name, f"{name}_cut"))


def filtration(pairs: DataFrame, shares: Sequence[float], keys: Sequence[str] = (), value: str = "distance") -> DataFrame:
    """(keys, level, u, v): the pairs within each quantile of value."""
    cuts = thresholds(pairs, value, shares, keys)
    rows = pairs.join(cuts, list(keys)) if keys else pairs.crossJoin(F.broadcast(cuts))
    return rows.where(F.col(value) <= F.col("level_cut")).select(*keys, "level", "u", "v")


def bifiltration(pairs: DataFrame, shares: Sequence[float], support_shares: Sequence[float], keys: Sequence[str] = (), value: str = "distance", support: str = "support") -> DataFrame:
    """(keys, level, s_level, u, v): pairs near enough and supported enough, over the grid of both."""
    near = thresholds(pairs, value, shares, keys)
    strong = thresholds(pairs, support, support_shares, keys, "s_level")
    grid = near.join(strong, list(keys)) if keys else near.crossJoin(strong)
    rows = pairs.join(grid, list(keys)) if keys else pairs.crossJoin(F.broadcast(grid))
    return rows.where((F.col(value) <= F.col("level_cut")) & (F.col(support) >= F.col("s_level_cut"))).select(*keys, "level", "s_level", "u", "v")


def _nodes_by_level(nodes: DataFrame, levels: DataFrame, keys: Sequence[str], more: Sequence[str]) -> DataFrame:
    at = levels.select(*keys, *more).distinct()
    return nodes.join(at, list(keys)) if keys else nodes.crossJoin(at)


def betti_curve(pairs: DataFrame, nodes: DataFrame, shares: Sequence[float], keys: Sequence[str] = (), value: str = "distance") -> DataFrame:
    """(keys, level, betti0, betti1, n_nodes): components and independent cycles at each quantile."""
    f = filtration(pairs, shares, keys, value)
    cuts = thresholds(pairs, value, shares, keys)
    ranks = cycle_rank(f, [*keys, "level"], _nodes_by_level(nodes, cuts, keys, ["level"]))
    return ranks.select(*keys, "level", F.col("n_components").alias("betti0"), F.col("rank").alias("betti1"), "n_nodes")


def cycle_surrogate(pairs: DataFrame, nodes: DataFrame, shares: Sequence[float], keys: Sequence[str] = (), value: str = "distance", least: int = 8) -> DataFrame:
    """(keys, mean, most): cycle ranks of a slice's graphs over the quantiles of value; null under `least` nodes or pairs."""
    b = betti_curve(pairs, nodes, shares, keys, value).groupBy(*keys).agg(F.avg("betti1").alias("__mean"), F.max("betti1").cast("double").alias("__most"))
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    m = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    rows = b.join(n, list(keys)).join(m, list(keys)) if keys else b.crossJoin(n).crossJoin(m)
    enough = (F.col("__n") >= least) & (F.col("__m") >= least)
    return rows.select(*keys, F.when(enough, F.col("__mean")).alias("mean"), F.when(enough, F.col("__most")).alias("most"))


def bifiltration_curve(pairs: DataFrame, nodes: DataFrame, shares: Sequence[float], support_shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    f = bifiltration(pairs, shares, support_shares, keys)
    near, strong = thresholds(pairs, "distance", shares, keys), thresholds(pairs, "support", support_shares, keys, "s_level")
    grid = near.join(strong, list(keys)) if keys else near.crossJoin(strong)
    ranks = cycle_rank(f, [*keys, "level", "s_level"], _nodes_by_level(nodes, grid, keys, ["level", "s_level"]))
    return ranks.select(*keys, "level", "s_level", F.col("n_components").alias("betti0"), F.col("rank").alias("betti1"))


def edge_cycle_scores(pairs: DataFrame, nodes: DataFrame, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, u, v, score): mean cycle rank over the quantiles at which the pair is in."""
    f = filtration(pairs, shares, keys)
    b = betti_curve(pairs, nodes, shares, keys).select(*keys, "level", "betti1")
    return f.join(b, [*keys, "level"]).groupBy(*keys, "u", "v").agg(F.avg("betti1").alias("score"))


def edge_connectivity(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, shares: Sequence[float], keys: Sequence[str] = (), value: str = "distance") -> DataFrame:
    """(keys, u, v, trajectory, share): for each quantile whether the ends are in one component."""
    f = filtration(pairs, shares, keys, value)
    cuts = thresholds(pairs, value, shares, keys)
    c = components(f, [*keys, "level"], _nodes_by_level(nodes, cuts, keys, ["level"]))
    rows = edges.select(*keys, "u", "v").join(c.withColumnRenamed("node", "u").withColumnRenamed("component", "cu"), [*keys, "u"])
    rows = rows.join(c.withColumnRenamed("node", "v").withColumnRenamed("component", "cv"), [*keys, "level", "v"])
    same = (F.col("cu") == F.col("cv")).cast("int")
    g = rows.groupBy(*keys, "u", "v").agg(F.array_sort(F.collect_list(F.struct("level", same.alias("s")))).alias("t"), F.avg(same).alias("share"))
    return g.select(*keys, "u", "v", F.transform("t", lambda x: x["s"]).alias("trajectory"), "share")


def trajectory_shape(df: DataFrame, column: str = "trajectory") -> DataFrame:
    """df with area, onset (first step that is set, else the length), rise, slope and roughness of an array."""
    t = F.col(column)
    n = F.size(t)
    area = F.aggregate(t, F.lit(0.0), lambda a, x: a + x) / n
    hit = F.array_position(F.transform(t, lambda x: (x > 0).cast("int")), F.lit(1))
    steps = F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1), lambda a, b: b - a)
    rough = F.aggregate(F.transform(steps, lambda d: F.abs(d).cast("double")), F.lit(0.0), lambda a, x: a + x)
    mid = (n - 1) / 2.0
    sxy = F.aggregate(F.transform(t, lambda x, i: (i - mid) * x), F.lit(0.0), lambda a, x: a + x)
    sxx = n * (n * n - 1) / 12.0
    return df.withColumns({"area": area, "onset": F.when(hit > 0, hit - 1).otherwise(n), "rise": (t[n - 1] - t[0]).cast("double"), "slope": sxy / sxx, "roughness": rough})


def signed_path_scores(edges: DataFrame) -> DataFrame:
    """(source, target, score): two-step paths there less those back, and tanh of 3.5 times the margin,
    of directed edges (source, target, margin)."""
    e = edges.select("source", "target", "margin")
    two = e.select(F.col("source").alias("i"), F.col("target").alias("k")).join(e.select(F.col("source").alias("k"), F.col("target").alias("j")), "k").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    ahead = e.join(two.select(F.col("i").alias("source"), F.col("j").alias("target"), F.col("n").alias("there")), ["source", "target"], "left")
    rows = ahead.join(two.select(F.col("j").alias("source"), F.col("i").alias("target"), F.col("n").alias("back")), ["source", "target"], "left")
    return rows.select("source", "target", (F.coalesce("there", F.lit(0)) - F.coalesce("back", F.lit(0)) + F.tanh(3.5 * F.col("margin"))).alias("score"))


def zigzag(first: DataFrame, second: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, first, second, union, long, total): cycles of two undirected graphs, of their union and of their
    intersection: on graphs first homology is the cycle space, so four cycle ranks say all."""
    both = first.select(*keys, "u", "v").unionByName(second.select(*keys, "u", "v")).distinct()
    common = first.select(*keys, "u", "v").intersect(second.select(*keys, "u", "v"))
    tagged = None
    for name, e in (("first", first), ("second", second), ("union", both), ("long", common)):
        t = e.select(*keys, "u", "v").distinct().withColumn("part", F.lit(name))
        tagged = t if tagged is None else tagged.unionByName(t)
    parts = F.explode(F.array(*[F.lit(x) for x in ("first", "second", "union", "long")]))
    ranks = cycle_rank(tagged, [*keys, "part"], nodes.select(*keys, "node", parts.alias("part")))
    one = lambda name: F.max(F.when(F.col("part") == name, F.col("rank")))
    g = ranks.groupBy(*keys).agg(*[one(x).alias(x) for x in ("first", "second", "union", "long")])
    return g.withColumn("total", F.col("first") + F.col("second") + F.col("union") - F.col("long"))


def directed_flags(edges: DataFrame) -> DataFrame:
    """(n_edges, n_flags): edges and directed triangles a->b->c, a->c, which fill cycles of the flag complex."""
    e = edges.where("source <> target").select("source", "target").distinct()
    ab, bc, ac = e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("a", "c")
    t = ab.join(bc, "b").join(ac, ["a", "c"]).agg(F.count(F.lit(1)).alias("n_flags"))
    return e.agg(F.count(F.lit(1)).alias("n_edges")).crossJoin(t)


def two_axis_connectivity(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, shares: Sequence[float], support_shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, u, v, one_axis, two_axis, gain): share of thresholds at which the ends are connected, by
    distance alone and over the grid of distance and support."""
    one = edge_connectivity(edges, pairs, nodes, shares, keys).select(*keys, "u", "v", F.col("share").alias("one_axis"))
    f = bifiltration(pairs, shares, support_shares, keys)
    near, strong = thresholds(pairs, "distance", shares, keys), thresholds(pairs, "support", support_shares, keys, "s_level")
    grid = near.join(strong, list(keys)) if keys else near.crossJoin(strong)
    by = [*keys, "level", "s_level"]
    c = components(f, by, _nodes_by_level(nodes, grid, keys, ["level", "s_level"]))
    rows = edges.select(*keys, "u", "v").join(c.withColumnRenamed("node", "u").withColumnRenamed("component", "cu"), [*keys, "u"])
    rows = rows.join(c.withColumnRenamed("node", "v").withColumnRenamed("component", "cv"), [*by, "v"])
    two = rows.groupBy(*keys, "u", "v").agg(F.avg((F.col("cu") == F.col("cv")).cast("int")).alias("two_axis"))
    return one.join(two, [*keys, "u", "v"]).withColumn("gain", F.col("two_axis") - F.col("one_axis"))


def rank_pairs(pairs: DataFrame, value: str, keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """pairs with the average-rank share of a value among all pairs of the slice."""
    return pairs.withColumn(out, rank_share(value, keys))


def regime(edges: DataFrame, n_nodes: int) -> DataFrame:
    """(density, orientation_entropy, balance, margin_iqr) of oriented edges (source, target, margin)."""
    p = F.avg((F.col("margin") > 0).cast("double"))
    h = F.when((p > 0) & (p < 1), -(p * F.ln(p) + (1 - p) * F.ln(1 - p))).otherwise(F.lit(0.0))
    q = F.percentile("margin", F.array(F.lit(0.25), F.lit(0.75)))
    return edges.agg((F.count(F.lit(1)) / F.lit(n_nodes * (n_nodes - 1))).alias("density"), h.alias("orientation_entropy"), (1 - F.abs(2 * p - 1)).alias("balance"), (q[1] - q[0]).alias("margin_iqr"))
