"""Descriptors of edges, nodes and modules: shapes of trajectories, signatures of nodes, vectors and
landscapes of modules, and the columns that models of them are given. All are column expressions,
joins and aggregates."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import random as R
from ..functions.stats import rank_bins, zscore
from . import graph, models, vectors

# trajectories


def _mean(xs: Column) -> Column:
    return X.total(xs) / F.size(xs)


def _steps(xs: Column) -> Column:
    return F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: b - a)


def _abs(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.abs(x))


SPECTRUM = ("area", "onset", "rise", "entropy", "step", "step_abs", "peak", "bend")


def derivative_spectrum(trajectory: Column | str, level: float = 0.5) -> dict[str, Column]:
    """An array in eight numbers: mean, first place over `level` (its length where none is), end less
    start, entropy of the steps' sizes, mean step and its size, place of the largest step, mean size
    of the second differences; places and entropy as shares of the most. All 0 under two entries."""
    t = F.col(trajectory) if isinstance(trajectory, str) else trajectory
    n, d1 = F.size(t), _steps(t)
    size, m = _abs(d1), F.size(d1)
    hit = F.array_position(F.transform(t, lambda x: x > level), F.lit(True))
    mass = F.greatest(X.total(size), F.lit(1e-8))
    share = F.transform(size, lambda a: a / mass)
    entropy = -X.total(F.transform(share, lambda p: p * F.ln(F.greatest(p, F.lit(1e-8))))) / F.ln(F.greatest(m, F.lit(2)).cast("double"))
    d2 = _steps(d1)
    made = {
        "area": _mean(t), "onset": F.when(hit > 0, hit - 1).otherwise(n) / F.greatest(n - 1, F.lit(1)), "rise": t[n - 1] - t[0], "entropy": entropy,
        "step": _mean(d1), "step_abs": _mean(size), "peak": (F.array_position(size, F.array_max(size)) - 1) / F.greatest(m - 1, F.lit(1)),
        "bend": F.when(F.size(d2) > 0, _mean(_abs(d2))).otherwise(F.lit(0.0)),
    }
    return {k: F.when(n < 2, F.lit(0.0)).otherwise(v) for k, v in made.items()}


#: Columns whose difference between two spectra is a feature; the others' differences are not stable.
CONTRASTED = ("area", "onset", "rise", "entropy", "step_abs", "bend")


def spectrum_contrast(one: Column | str, two: Column | str) -> dict[str, Column]:
    """Both spectra, as <name>_1 and <name>_2, and the second's excess over the first, as <name>_gap."""
    a, b = derivative_spectrum(one), derivative_spectrum(two)
    return {f"{k}_1": v for k, v in a.items()} | {f"{k}_2": v for k, v in b.items()} | {f"{k}_gap": b[k] - a[k] for k in CONTRASTED}


VINEYARD = ("slope", "roughness", "curvature", "crossings", "span", "level", "rise")


def vineyard(trajectory: Column | str, strengths: Sequence[float]) -> dict[str, Column]:
    """An array over given strengths: slope, mean size of steps and of second differences, changes of
    the steps' sign, span, level and end less start."""
    t = F.col(trajectory) if isinstance(trajectory, str) else trajectory
    centre = sum(strengths) / len(strengths)
    s = F.array(*[F.lit(float(x - centre)) for x in strengths])
    spread = max(1e-8, sum((x - centre) ** 2 for x in strengths))
    level, d1 = _mean(t), _steps(t)
    d2 = _steps(d1)
    turns = F.zip_with(F.slice(d1, 1, F.greatest(F.size(d1) - 1, F.lit(0))), F.slice(d1, 2, F.greatest(F.size(d1) - 1, F.lit(0))), lambda a, b: (F.signum(a) * F.signum(b) < 0).cast("double"))
    mean_or_0 = lambda xs: F.when(F.size(xs) > 0, _mean(_abs(xs))).otherwise(F.lit(0.0))
    return {
        "slope": X.total(F.zip_with(s, t, lambda a, x: a * (x - level))) / spread, "roughness": mean_or_0(d1), "curvature": mean_or_0(d2),
        "crossings": X.total(turns), "span": F.array_max(t) - F.array_min(t), "level": level, "rise": t[F.size(t) - 1] - t[0],
    }


def rises_then_holds(d0: Column, d1: Column, d2: Column, d3: Column, slack: float = 0.003) -> Column:
    """1 where a value rises over the first three layers and the last falls short by `slack` at most."""
    return ((d1 > d0) & (d2 > d1) & (d3 >= d2 - slack)).cast("int")


def sample_skew(x: Column | str) -> Column:
    """Mean of the cubed z-scores by the sample deviation; null under 3 values, 0 where they are flat. An
    aggregate."""
    x = F.col(x) if isinstance(x, str) else x
    n, m, sd = F.count(x), F.avg(x), F.stddev_samp(x)
    third = F.avg(x * x * x) - 3 * m * F.avg(x * x) + 2 * m * m * m
    return F.when(n < 3, None).when(sd <= 1e-12, F.lit(0.0)).otherwise(third / (sd * sd * sd))


# dimension curves


def dimension_curves(neighbours: DataFrame, ks: Sequence[int], keys: Sequence[str] = (), low: float = 0.1, high: float = 200.0) -> DataFrame:
    """(id, forward, backward): for each k the estimate from the k nearest neighbours, and from those
    beyond the (k - 1)-th (the three nearest, where fewer are left)."""
    most = F.max("rank")
    r = F.greatest("distance", F.lit(1e-8))
    g = neighbours.groupBy(*keys, "id").agg(most.alias("n"), F.array_sort(F.collect_list(F.struct("rank", r.alias("r")))).alias("near"))
    d = F.transform("near", lambda e: e["r"])

    def estimate(xs):
        k = F.size(xs)
        far = xs[k - 1]
        logs = F.transform(F.slice(xs, 1, k - 1), lambda x: F.ln(F.greatest(far / x, F.lit(1 + 1e-8))))
        return F.greatest(F.lit(low), F.least(F.lit(high), (k - 1) / F.greatest(X.total(logs), F.lit(1e-8))))

    def used(k):
        return F.greatest(F.least(F.lit(k), F.col("n")), F.least(F.lit(3), F.col("n")))

    forward = F.array(*[estimate(F.slice(d, 1, used(k))) for k in ks])
    shell = lambda k: F.when(F.col("n") - used(k) + 1 < 3, F.slice(d, 1, F.least(F.lit(3), F.col("n")))).otherwise(F.slice(d, used(k), F.greatest(F.col("n") - used(k) + 1, F.lit(1))))
    return g.select(*keys, "id", forward.alias("forward"), F.array(*[estimate(shell(k)) for k in ks]).alias("backward"))


# signatures of nodes

GEOMETRIC = ("degree", "nearness", "clustering", "reach", "two_nn", "mle")
RELATIONAL = ("out_degree", "in_degree", "degree", "reciprocity", "clustering", "reach")


def geometric_signatures(points: DataFrame, k: int, keys: Sequence[str] = (), id_col: str = "vec_id", local: int = 14) -> DataFrame:
    """(node, GEOMETRIC): a point in its neighbour graph: share of nodes linked to it, z-score of minus
    the mean length of its links, clustering, share two steps away, z-scores of its local dimension."""
    near = vectors.knn(points, max(k, local), keys, id_col)
    edges = vectors.knn_edges(near.where(F.col("rank") <= k), keys)
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    both = edges.select(*keys, F.explode(F.array("u", "v")).alias("node"), "distance")
    links = both.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("__d"), F.avg("distance").alias("__far"))
    nodes = points.select(*keys, F.col(id_col).alias("node")).join(size, list(keys)) if keys else points.select(F.col(id_col).alias("node")).crossJoin(size)
    on = [*keys, "node"]
    rows = nodes.join(links, on, "left").join(graph.local_clustering(edges, keys).select(*on, "clustering"), on, "left")
    hops = graph.two_hop_reach(edges, 2, keys)  # over 2 - 1 others: a count
    rows = rows.join(hops.withColumnRenamed("reach", "__two"), on, "left")
    dims = vectors.local_dimension(near.where(F.col("rank") <= local), keys).withColumnRenamed("id", "node")
    rows = rows.join(dims, on, "left").na.fill(0.0, ["__far", "clustering", "__two", "two_nn", "mle"]).na.fill(0, ["__d"])
    others = F.greatest(F.col("__n") - 1, F.lit(1))
    rows = rows.withColumns({"degree": F.col("__d") / others, "reach": F.col("__two") / others, "__near": -F.col("__far")})
    return rows.select(*on, "degree", zscore("__near", keys).alias("nearness"), "clustering", "reach", zscore("two_nn", keys).alias("two_nn"), zscore("mle", keys).alias("mle"))


def relational_signatures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, RELATIONAL): a node in a directed graph (source, target): shares of nodes that it points to,
    that point to it, and either; how many of those do both; clustering; share two steps ahead."""
    e = edges.where("source <> target").select("source", "target").distinct()
    size = nodes.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("__others"))
    und = graph.undirected(e)
    count = lambda rows, node, name: rows.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias(name))
    mutual = e.join(e.select(F.col("target").alias("source"), F.col("source").alias("target")), ["source", "target"])
    ahead = e.join(e.select(F.col("source").alias("target"), F.col("target").alias("end")), "target").where("source <> end").select("source", "end").distinct()
    rows = nodes.select("node").distinct().crossJoin(F.broadcast(size))  # one row
    for part in (count(e, "source", "__o"), count(e, "target", "__i"), count(mutual, "source", "__m"), count(ahead, "source", "__a"), graph.local_clustering(und).select("node", F.col("degree").alias("__u"), "clustering")):
        rows = rows.join(part, "node", "left")
    rows = rows.na.fill(0, ["__o", "__i", "__m", "__a", "__u"]).na.fill(0.0, ["clustering"])
    share = lambda c: F.col(c) / F.col("__others")
    both = F.when(F.col("__u") > 0, F.col("__m") / F.col("__u")).otherwise(F.lit(0.0))
    return rows.select("node", share("__o").alias("out_degree"), share("__i").alias("in_degree"), share("__u").alias("degree"), both.alias("reciprocity"), "clustering", share("__a").alias("reach"))


def scaffold_signatures(layers: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 10, layer: str = "layer") -> tuple[DataFrame, DataFrame]:
    """Geometric signatures of the nodes in each layer, and relational ones of the same nodes in the other graph."""
    inside = layers.join(nodes.select(F.col("node").alias("vec_id")).distinct(), "vec_id", "left_semi")
    return geometric_signatures(inside, k, [layer]), relational_signatures(edges, nodes)


def positive_adjacency(edges: DataFrame, nodes: DataFrame, label: str = "label") -> DataFrame:
    """(i, j, w): how many positive edges join two of the nodes, in both orders; where there are none at
    all, each node with itself, so that a spectrum of it isn't empty."""
    n = nodes.select("node").distinct()
    e = edges.where((F.col(label) > 0) & (F.col("source") != F.col("target")))
    e = e.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi")
    both = e.select(F.explode(F.array(F.struct(F.col("source").alias("i"), F.col("target").alias("j")), F.struct(F.col("target").alias("i"), F.col("source").alias("j")))).alias("e"))
    w = both.groupBy("e.i", "e.j").agg(F.count(F.lit(1)).cast("double").alias("w"))
    total = w.agg(F.count(F.lit(1)).alias("__n"))
    alone = n.crossJoin(F.broadcast(total)).where("__n = 0").select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("w"))
    return w.unionByName(alone)


def source_activity(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """(node, activity): how many listed (source, target) pairs a node is the source of, whatever its case."""
    n = listed.select(F.upper(F.col("source").cast("string")).alias("name"), "target").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("activity"))
    rows = nodes.select("node", F.upper(F.col("node").cast("string")).alias("name")).join(n, "name", "left")
    return rows.select("node", F.coalesce("activity", F.lit(0)).cast("double").alias("activity"))


# descriptors of edges

SPARSE = ("bridge", "curvature_gap", "clearness", "support", "flatness", "tail_flatness", "close", "degree_sum")


def sparse_descriptors(edges: DataFrame, neighbour_edges: DataFrame, support: DataFrame, defects: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(u, v, SPARSE): degrees and clustering of the ends in the neighbour graph, directed support and its
    clearness, and the triangle defects of edge_geometry()."""
    nodes = graph.local_clustering(neighbour_edges, keys).select(*keys, "node", F.col("degree").cast("double").alias("d"), (1 - F.col("clustering")).alias("c"))
    rows = graph.with_ends(edges.select(*keys, "u", "v"), nodes, ["d", "c"], keys).na.fill(0.0, ["d_u", "d_v"]).na.fill(1.0, ["c_u", "c_v"])
    by = [*keys, "u", "v"]
    there = support.select(*keys, F.col("source").alias("u"), F.col("target").alias("v"), F.col("support").alias("there"))
    back = support.select(*keys, F.col("source").alias("v"), F.col("target").alias("u"), F.col("support").alias("back"))
    rows = rows.join(there, by, "left").join(back, by, "left").na.fill(0.0, ["there", "back"]).join(defects.select(*by, "defect_median", "defect_tail", "defect_close"), by)
    c = F.col
    gap = c("c_u") - c("c_v")
    return rows.select(
        *by, ((c("d_u") * c("c_u") + c("d_v") * c("c_v")) / 2).alias("bridge"), (gap * gap / 2).alias("curvature_gap"), F.abs(c("there") - c("back")).alias("clearness"),
        c("there").alias("support"), (-c("defect_median")).alias("flatness"), (-c("defect_tail")).alias("tail_flatness"), c("defect_close").alias("close"), (c("d_u") + c("d_v")).alias("degree_sum"),
    )


def relative_connectivity(base: Column, weighted: Column, margin: Column, confidence: Column, anchor: Mapping[str, Column], background: Mapping[str, Column]) -> dict[str, Column]:
    """The baseline block and the connectivity (one, two, gain) of an anchor set, of its background, and
    of the one over the other."""
    made = {"base": base, "weighted": weighted, "gain": weighted - base, "margin": margin, "confidence": confidence}
    made |= {f"anchor_{k}": anchor[k] for k in ("one", "two", "gain")} | {f"background_{k}": background[k] for k in ("one", "two", "gain")}
    return made | {f"relative_{k}": anchor[k] - background[k] for k in ("one", "two", "gain")}


def masked_by_stratum(base: Column, weighted: Column, margin: Column, confidence: Column, stratum: Column, strata: Sequence[int] = (0, 1, 2)) -> dict[str, Column]:
    """The baseline, and for each stratum the other columns where an edge is of it, else 0."""
    made = {"base": base}
    for k in strata:
        for name, c in (("weighted", weighted), ("gain", weighted - base), ("margin", margin), ("confidence", confidence)):
            made[f"{name}_{k}"] = F.when(stratum == k, c.cast("double")).otherwise(F.lit(0.0))
    return made


def gated(features: Mapping[str, Column], disagreement: Column, bin_: Column) -> dict[str, Column]:
    """Features, the disagreement, flags of its middle and upper bin, and the features under each flag."""
    mid, high = (F.when(bin_ == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in (1, 2))
    made = dict(features) | {"disagreement": disagreement, "mid": mid, "high": high}
    return made | {f"{k}_mid": c * mid for k, c in features.items()} | {f"{k}_high": c * high for k, c in features.items()}


def phase_model(base: Column, phase: Mapping[str, Column]) -> dict[str, Column]:
    """The baseline, a path's phase columns, and the baseline times hysteresis and times the slopes' gap."""
    return {"base": base, **phase, "base_hysteresis": base * phase["hysteresis"], "base_slope_gap": base * phase["slope_gap"]}


def sheaf_model(base: Column, same: Column, motif: Column, consistent: Column, confidence: Column, confident: Column, sheaf: Mapping[str, Column]) -> dict[str, Column]:
    """Sixteen columns of the sheaf screen: the edge's own, those of its charts (boundary, unknown,
    obstruction, compatibility, frequency), and five products."""
    made = {"base": base, "same": same, "motif": motif, "consistent": consistent, "confidence": confidence, "confident": confident}
    made |= {k: sheaf[k] for k in ("boundary", "unknown", "obstruction", "compatibility", "frequency")}
    o, c = sheaf["obstruction"], sheaf["compatibility"]
    return made | {
        "obstruction_consistent": o * consistent, "obstruction_confidence": o * confidence, "boundary_same": sheaf["boundary"] * same,
        "base_compatibility": base * c, "base_consistent_compatibility": base * consistent * c,
    }


def depth_tokens(df: DataFrame, base: str, gain: str, bins: int, row: str, layer: str = "layer") -> DataFrame:
    """(row, tokens): for each layer in order bins * the bin of base + the bin of gain, binned in the layer."""
    token = rank_bins(base, bins, [layer]) * bins + rank_bins(gain, bins, [layer])
    t = df.select(row, layer, token.cast("int").alias("t"))
    return t.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(layer, "t"))), lambda e: e["t"]).alias("tokens"))


# modules


def module_vectors(modules: DataFrame, roles: DataFrame, keys: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(module, n, vec): mean role vector of the members (module, node) that have one, of modules with `least` of them."""
    rows = modules.join(roles.select(*keys, "node", F.posexplode("vec").alias("d", "x")), "node")
    means = rows.groupBy(*keys, "module", "d").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    g = means.groupBy(*keys, "module").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("vec"))
    return g.where(F.col("n") >= least)


def common_modules(own: DataFrame, other: DataFrame, layer: str = "layer", least: int = 3) -> DataFrame:
    """(module): modules with a vector in every layer and in the other model; none where there are fewer than `least`."""
    layers = own.agg(F.count_distinct(layer).alias("layers"))
    held = own.groupBy("module").agg(F.count_distinct(layer).alias("in")).crossJoin(F.broadcast(layers)).where(F.col("in") == F.col("layers"))
    both = held.select("module").join(other.select("module").distinct(), "module")
    return both.crossJoin(F.broadcast(both.agg(F.count(F.lit(1)).alias("__n")))).where(F.col("__n") >= least).select("module")


def normalised_modules(modules: DataFrame, keys: Sequence[str] = (), unit_where: Column | None = None) -> DataFrame:
    """Vectors with every dimension at mean 0 and deviation 1 over the modules of a slice, and of length 1 where the flag says so."""
    long = modules.select(*keys, "module", F.posexplode("vec").alias("d", "x"))
    scaled = long.withColumn("x", zscore("x", [*keys, "d"]))
    g = scaled.groupBy(*keys, "module").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda e: e["x"]).alias("vec"))
    return g if unit_where is None else g.withColumn("vec", F.when(unit_where, X.unit("vec")).otherwise(F.col("vec")))


LANDSCAPE = ("q10", "q25", "q50", "q75", "q90", "mean", "sd")


def module_landscape(points: DataFrame, modules: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id", least: int = 3) -> DataFrame:
    """(module, n, LANDSCAPE): quantiles, mean and deviation of the distances between a module's members;
    all 0 under `least` members. Pairs are measured block against block and counted, never rows."""
    by = [*keys, "module"]
    held = modules.select("module", F.col("node").alias(id_col)).join(points, id_col).select(*by, id_col, "vec")
    far = vectors.pair_quantiles(held, (0.1, 0.25, 0.5, 0.75, 0.9), by, id_col)
    rows = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(far, by, "left")
    cols = {name: F.col("q")[i] for i, name in enumerate(LANDSCAPE[:5])} | {"mean": F.col("mean"), "sd": F.col("sd")}
    return rows.select(*by, "n", *[F.when(F.col("n") >= least, c).otherwise(F.lit(0.0)).alias(k) for k, c in cols.items()])


def module_interaction(df: DataFrame, module: str, support: str, label: str, base: str, other: str, least: int = 40, least_rows: int = 1) -> DataFrame:
    """(interaction): how much more the other score gains over the base in the upper third of support than
    in the lower, as a mean over modules of `least` rows, weighted by their rows."""
    cut = df.groupBy(module).agg(F.count(F.lit(1)).alias("n"), F.percentile(support, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    rows = df.join(cut.where((F.col("n") >= least) & (F.col("lo") < F.col("hi"))), module)
    ends = F.array_compact(F.array(F.when(F.col(support) >= F.col("c")[1], F.lit("high")), F.when(F.col(support) <= F.col("c")[0], F.lit("low"))))
    rows = rows.withColumn("__end", F.explode(ends))
    d = models.subset_delta_auc(rows, label, base, other, [module, "__end"], least_rows)
    g = d.groupBy(module).agg(F.max(F.when(F.col("__end") == "high", F.col("delta_auc"))).alias("high"), F.max(F.when(F.col("__end") == "low", F.col("delta_auc"))).alias("low"))
    gap = g.join(cut.select(module, "n"), module).where("high is not null and low is not null").withColumn("gap", F.col("high") - F.col("low"))
    return gap.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("interaction"))


# cells


def sampled(cells: DataFrame, n: int, cell: str = "cell", salt: str = "cells") -> DataFrame:
    """At most n cells, by hash."""
    return cells.select(cell).distinct().orderBy(R.key(cell, salt=salt), cell).limit(n)


def absolute_correlations(values: DataFrame, cell: str = "cell", gene: str = "gene", value: str = "value") -> DataFrame:
    """(a, b, r): absolute correlation of each pair of genes over all cells, in a matrix where what is not
    listed is 0; 0 for a flat gene. Genes are a bounded selection; sums go over the common cells."""
    n = values.agg(F.count_distinct(cell).alias("n"))
    own = values.groupBy(gene).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    x = values.select(cell, F.col(gene).alias("a"), F.col(value).alias("x"))
    y = values.select(cell, F.col(gene).alias("b"), F.col(value).alias("y"))
    prod = x.join(y, cell).where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    every = own.select(F.col(gene).alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")).join(own.select(F.col(gene).alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), F.col("a") < F.col("b"))
    rows = every.join(prod, ["a", "b"], "left").na.fill(0.0, ["p"]).crossJoin(F.broadcast(n))
    va, vb = (F.col("n") * F.col(f"q{e}") - F.col(f"s{e}") * F.col(f"s{e}") for e in "ab")
    r = (F.col("n") * F.col("p") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)
    return rows.select("a", "b", F.when((va > 1e-12) & (vb > 1e-12), F.abs(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))).otherwise(F.lit(0.0)).alias("r"))


# whole-number choices


def ordered(value: Column, categories: Sequence[str]) -> Column:
    """The place of a category in its order; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in categories]), value), F.lit(0).cast("long")) - 1


def permutations(xs: Column | str, n: int) -> Column:
    """All orders of an array of n entries (at most 7, so 5,040 orders), as an array of arrays."""
    if n > 7:
        raise ValueError("at most 7 entries")
    xs = F.col(xs) if isinstance(xs, str) else xs
    return F.array(*[F.array(*[xs[i] for i in o]) for o in itertools.permutations(range(n))])


def exact_permutation_p(df: DataFrame, array: str, n: int, statistic, keys: Sequence[str]) -> DataFrame:
    """(keys, observed, n_orders, p): share of all orders of the array whose statistic reaches the observed one."""
    seen = statistic(F.col(array))
    rows = df.select(*keys, seen.alias("observed"), F.transform(permutations(array, n), statistic).alias("__all"))
    hit = F.size(F.filter("__all", lambda s: s >= F.col("observed") - 1e-12))
    return rows.select(*keys, "observed", F.size("__all").alias("n_orders"), (hit / F.size("__all")).alias("p"))


#: Fixed values: (domain, split, nodes at most, nodes at least, edges) of a slice; any other slice has the last row's.
BUDGETS = (
    ("external_lung", "dual_axis_disjoint", 280, 75, 170),
    ("external_lung", None, 220, 95, 200),
    ("immune", "dual_axis_disjoint", 210, 90, 195),
    (None, None, 170, 120, 220),
)


def with_budget(df: DataFrame, domain: str = "domain", split: str = "split") -> DataFrame:
    """df with node_cap, least_nodes and edge_sample of its slice."""
    out = None
    for d, s, *numbers in BUDGETS:
        hit = F.lit(True)
        if d is not None:
            hit = hit & F.col(domain).eqNullSafe(F.lit(d))
        if s is not None:
            hit = hit & F.col(split).eqNullSafe(F.lit(s))
        value = F.struct(*[F.lit(x).alias(c) for c, x in zip(("node_cap", "least_nodes", "edge_sample"), numbers, strict=True)])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return df.withColumn("__b", out).select(*df.columns, "__b.node_cap", "__b.least_nodes", "__b.edge_sample")
