"""Kernels and rewirings against their formulas, worked out by hand or in plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import descriptors as D
from orrery.operators import geometry as G
from orrery.operators import graph, models, topology, vectors
from orrery.operators import kernels as K


def line_graph(n=6):
    """Distances of n points on a line at the squares of their numbers."""
    x = np.arange(n, dtype=float) ** 2
    return np.abs(x[:, None] - x[None, :])


def test_triangle_defects_by_their_formula():
    g = line_graph(7) + 0.5 * (1 - np.eye(7))
    u, v = np.array([0, 1, 4]), np.array([2, 5, 6])
    got = K.triangle_defects(g, u, v, ks=(2, 4))
    for e, (a, b) in enumerate(zip(u, v, strict=True)):
        base = g[a, b]
        ways = sorted(g[a, c] + g[b, c] for c in range(7) if c not in (a, b))
        med, tail, close = [], [], []
        for k in (2, 4):
            excess = [max(0.0, (w - base) / base) for w in ways[:k]]
            med.append(np.quantile(excess, 0.5))
            tail.append(np.quantile(excess, 0.9))
            close.append(np.mean([x <= 0.05 for x in excess]))
        want = [np.mean(med), np.mean(tail), np.mean(close), np.mean(np.array(tail) - np.array(med)), tail[-1] - tail[0]]
        assert [got[c][e] for c in ("defect_median", "defect_tail", "defect_close", "defect_dispersion", "defect_span")] == pytest.approx(want)
    assert all(x[0] == 0 for x in K.triangle_defects(g, np.array([3]), np.array([3])).values())
    drawn = K.triangle_defects(g, u, v, ks=(5,), draw=np.random.default_rng(1))
    assert drawn["defect_median"] == pytest.approx(K.triangle_defects(g, u, v, ks=(5,))["defect_median"])


def test_scores_weigh_directed_support():
    rng = np.random.default_rng(3)
    g, s = line_graph(8) + 1, rng.random((8, 8))
    u, v = np.array([0, 1, 2, 5]), np.array([3, 4, 7, 6])
    f = K.triangle_defects(g, u, v)
    z = lambda x: (x - x.mean()) / x.std() if x.std() > 1e-8 else 0 * x
    margin = np.abs(s[u, v] - s[v, u])
    want = z(-g[u, v]) + 0.75 * z(s[u, v]) + 0.35 * z(margin) + 0.35 * z(-f["defect_median"]) + 0.25 * z(-f["defect_tail"]) + 0.2 * z(f["defect_close"]) - 0.1 * z(f["defect_span"]) - 0.1 * z(f["defect_dispersion"])
    assert K.base_score(g, s, u, v, f) == pytest.approx(want)
    mean = (s[u, v] + s[v, u]) / 2
    assert K.support_score(g, s, u, v) == pytest.approx(z(-g[u, v] / (0.35 + mean)) + 0.7 * z(mean) + 0.3 * z(margin))


def test_turning_of_a_staircase():
    p = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 1.0]])
    assert K.turning(p) == pytest.approx((math.pi / 2, 0, math.pi / 2, math.pi / 2))
    assert K.turning(p[[0, 1, 1, 2]])[0] == pytest.approx(math.pi / 2) and K.turning(p[:2]) == (0, 0, 0, 0)
    flat = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [2, 1, 0.0]])
    assert K.turning(flat) == pytest.approx((math.pi / 2, 0, math.pi, 0)) or K.turning(flat)[3] == 0


def test_phase_of_two_profiles():
    there, back = np.array([1.0, 3, 2, 4]), np.array([4.0, 2, 1])
    flips, hysteresis, slopes, lengths, level, spread = G.phase_of(there, back)
    aligned = back[::-1]
    assert flips == 2 and lengths == 1 and slopes == (4 - 1) + (1 - 4)
    assert hysteresis == pytest.approx(np.abs(there[:3] - aligned).mean() / np.abs(np.r_[there[:3], aligned]).mean())
    assert level == pytest.approx((there.mean() + back.mean()) / 2) and spread == pytest.approx((there.std() + back.std()) / 2)
    assert G.phase_of(there, there[::-1])[1] == 0


def test_fractures_of_a_bend():
    way = np.array([[0, 0], [1, 0], [2, 0], [3, 0], [3, 1], [3, 2], [3, 3.0]])
    count, density, most, mean, _ = G._fractures(way, 3, 35.0)
    axes = [np.linalg.svd(way[i : i + 3] - way[i : i + 3].mean(0))[2][0] for i in range(5)]
    angles = [math.degrees(math.acos(min(1, abs(a @ b)))) for a, b in itertools.pairwise(axes)]
    assert (count, density) == (sum(a > 35 for a in angles), sum(a > 35 for a in angles) / 4) and (most, mean) == pytest.approx((max(angles), np.mean(angles)))
    assert G._fractures(way[:3], 3, 35.0) == [0.0] * 5


def test_curvature_drift_is_from_the_first_edge_to_the_last(spark):
    chain = [(0, i, [float(i), 0.0]) for i in range(6)] + [(0, 6, [2.0, 0.9]), (0, 7, [2.0, -0.9])]
    points = spark.createDataFrame(chain, "layer int, vec_id long, vec array<double>")
    edges = spark.createDataFrame([(0, 0, 5)], "layer int, u long, v long")
    r = G.path_curvature(points, edges, ["layer"], k=2).first()
    d = K.pairwise(np.array([c[2] for c in chain]))
    w = K.connect(K.knn_adjacency(d, 2), d)
    deg = (np.isfinite(w) & ~np.eye(8, dtype=bool)).sum(1)
    way = K.path(K.shortest_paths(w)[1], 0, 5)
    c = [4 - deg[a] - deg[b] for a, b in itertools.pairwise(way)]
    assert (r["mean"], r.least, r.drift, r.hops) == pytest.approx((np.mean(c), min(c), abs(c[-1] - c[0]), len(c)))


@pytest.mark.parametrize("f", [G.path_torsion, G.path_fractures])
def test_paths_with_support_turn_with_their_ends(spark, f):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(0, i, [float(x) for x in rng.normal(size=4)]) for i in range(20)], "layer int, vec_id long, vec array<double>")
    edges = spark.createDataFrame([(0, i, (i * 7 + 3) % 20) for i in range(20) if i != (i * 7 + 3) % 20], "layer int, u long, v long")
    support = spark.createDataFrame([(0, i, j, float(rng.random())) for i in range(20) for j in range(20) if i != j and rng.random() < 0.4], "layer int, source long, target long, support double")
    there = f(points, edges, ["layer"], k=4, support=support)
    turned = f(points, edges.select("layer", F.col("v").alias("u"), F.col("u").alias("v")), ["layer"], k=4, support=support)
    names = there.columns[3:]
    other = {(r.v, r.u): [r[c] for c in names] for r in turned.collect()}
    for r in G.swapped(there).collect():
        assert [r[c] for c in names] == pytest.approx(other[r.u, r.v], abs=1e-9)
    twice = {(r.u, r.v): [r[c] for c in names] for r in G.swapped(G.swapped(there)).collect()}
    assert all([r[c] for c in names] == pytest.approx(twice[r.u, r.v]) for r in there.collect())


def cloud_edges(spark, n=30, k=4):
    rng = np.random.default_rng(11)
    points = spark.createDataFrame([(0, i, [float(x) for x in rng.normal(size=3)]) for i in range(n)], "layer int, vec_id long, vec array<double>")
    return points, vectors.knn_edges(vectors.knn(points, k, ["layer"]), ["layer"])


def degrees(rows):
    out = {}
    for r in rows:
        for x in (r.u, r.v):
            out[x] = out.get(x, 0) + 1
    return out


def test_rewired_graphs_keep_what_they_name(spark):
    points, edges = cloud_edges(spark)
    before = edges.collect()
    far = vectors.pairs(points, ["layer"])
    strata = far.select("layer", "u", "v", ((F.col("u") + F.col("v")) % 3).cast("int").alias("stratum"))
    after = models.rewired_in_strata(edges, strata, ["layer"]).collect()
    assert degrees(after) == degrees(before) and {(r.u, r.v) for r in after} != {(r.u, r.v) for r in before}
    count = lambda rows: sorted((r.u + r.v) % 3 for r in rows)
    assert count(after) == count(before)

    matched = models.rewired_to_lengths(edges, points, ["layer"], trials=8).collect()
    assert degrees(matched) == degrees(before) and len(matched) == len(before)
    assert K.parts(np.array([(r.u, r.v) for r in matched])) == K.parts(np.array([(r.u, r.v) for r in before]))

    drawn = models.drawn_by_degree(edges, ["layer"]).collect()
    assert len(drawn) == len(before) == len({(r.u, r.v) for r in drawn}) and all(r.u < r.v for r in drawn)
    assert sorted(r.distance for r in drawn) == pytest.approx(sorted(r.distance for r in before))


def test_random_transport_has_fixed_marginals():
    m = K.doubly_stochastic(7, np.random.default_rng(2))
    assert (m > 0).all() and m.sum(0) == pytest.approx(1 / 7) and m.sum(1) == pytest.approx(1 / 7, abs=1e-6)


def test_sparse_descriptors_by_their_formula(spark):
    points, near = cloud_edges(spark)
    edges = spark.createDataFrame([(0, i, (i * 11 + 5) % 30) for i in range(30) if i != (i * 11 + 5) % 30], "layer int, u long, v long")
    support = edges.select("layer", F.col("u").alias("source"), F.col("v").alias("target"), (F.col("u") * 0.01).alias("support"))
    defects = G.edge_geometry(points, edges, ["layer"], support, k=4)
    got = {(r.u, r.v): r for r in D.sparse_descriptors(edges, near, support, defects, ["layer"]).collect()}
    nodes = {r.node: r for r in graph.local_clustering(near, ["layer"]).collect()}
    s = {(r.source, r.target): r.support for r in support.collect()}
    for r in defects.collect():
        a, b, d = nodes[r.u], nodes[r.v], got[r.u, r.v]
        ca, cb = 1 - a.clustering, 1 - b.clustering
        want = [(a.degree * ca + b.degree * cb) / 2, (ca - cb) ** 2 / 2, abs(s.get((r.u, r.v), 0) - s.get((r.v, r.u), 0)), s[r.u, r.v], -r.defect_median, -r.defect_tail, r.defect_close, a.degree + b.degree]
        assert [d[c] for c in D.SPARSE] == pytest.approx(want)


def test_cycle_surrogate_is_mean_and_largest_cycle_rank(spark):
    points, _ = cloud_edges(spark, 12)
    far = vectors.pairs(points, ["layer"]).select("layer", "u", "v", ((F.col("x")[0] - F.col("y")[0]) * (F.col("x")[0] - F.col("y")[0])).alias("distance"))
    nodes = points.select("layer", F.col("vec_id").alias("node"))
    shares = [0.1, 0.3, 0.6]
    r = topology.cycle_surrogate(far, nodes, shares, ["layer"]).first()
    rows = far.collect()
    d = np.array([x.distance for x in rows])
    ranks = []
    for q in shares:
        kept = np.array([(x.u, x.v) for x in rows if x.distance <= np.quantile(d, q)])
        alone = 12 - len(np.unique(kept))
        ranks.append(len(kept) - 12 + K.parts(kept) + alone)
    assert (r["mean"], r["most"]) == pytest.approx((np.mean(ranks), max(ranks)))
    few = topology.cycle_surrogate(far.where("u < 3 and v < 3"), nodes.where("node < 3"), shares, ["layer"]).first()
    assert few["mean"] is None


def test_exact_orders_and_places(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0])], "k int, xs array<double>")
    r = D.exact_permutation_p(df, "xs", 3, lambda x: x[2] - x[0], ["k"]).first()
    assert (r.observed, r.n_orders, r.p) == (3.0, 6, pytest.approx(1 / 6))
    with pytest.raises(ValueError):
        D.permutations("xs", 8)
    rows = spark.createDataFrame([("lo",), ("hi",), ("?",), (None,)], "c string").select(D.ordered(F.col("c"), ["lo", "mid", "hi"]).alias("p")).collect()
    assert [r.p for r in rows] == [0, 2, None, None]


def test_empty_graphs_and_short_trajectories(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    none = spark.createDataFrame([], "source long, target long, label int")
    assert sorted(map(tuple, D.positive_adjacency(none, nodes).collect())) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert sorted(map(tuple, graph.hop_matrix(none, nodes).collect())) == [(1, 1, 0.0), (1, 2, 2.0), (2, 1, 2.0), (2, 2, 0.0)]
    short = spark.createDataFrame([([1.0],), ([0.0, 0.7],)], "t array<double>").select(*[c.alias(k) for k, c in D.derivative_spectrum("t").items()]).collect()
    assert list(short[0]) == [0] * 8 and (short[1].onset, short[1].rise, short[1].bend) == (1.0, pytest.approx(0.7), 0.0)
    assert models.linear_predict(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), spark.createDataFrame([(3.0,)], "x double"), ["x"], "y").first().predicted is None
