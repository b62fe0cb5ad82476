"""Slice operators on a small cloud: invariants, symmetries and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import alignment as A
from orrery.operators import geometry as G
from orrery.operators import topology as T
from orrery.operators import vectors as V


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    rows = [(layer, i, [float(x) for x in rng.normal(size=5) + layer]) for layer in (0, 1) for i in range(24)]
    return spark.createDataFrame(rows, "layer int, vec_id long, vec array<double>").cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(layer, i, (i * 7 + 3) % 24, float(i % 5) / 5) for layer in (0, 1) for i in range(24) if i != (i * 7 + 3) % 24], "layer int, u long, v long, support double")


@pytest.fixture(scope="module")
def support(edges):
    return edges.select("layer", F.col("u").alias("source"), F.col("v").alias("target"), "support")


def back(df, features):
    return {(r.layer, r.u, r.v): [r[c] for c in features] for r in df.collect()}


def test_edge_geometry(cloud, edges, support):
    g = G.edge_geometry(cloud, edges, ["layer"], support, k=4)
    rows = g.collect()
    assert len(rows) == edges.count() and all(r.geodesic >= r.euclidean - 1e-9 and r.detour >= 1 - 1e-9 and r.hops >= 1 and 0 <= r.deficit <= 1 for r in rows)
    assert all(r.defect_median >= -1e-9 and 0 <= r.defect_close <= 1 for r in rows)


def test_direction_swaps(cloud, edges, support):
    names = ["log_ratio", "forward", "backward", "hop_gap", "support_gap", "path_support", "margin"]
    there = G.direction_features(cloud, edges, ["layer"], support, k=4)
    turned = edges.select("layer", F.col("v").alias("u"), F.col("u").alias("v"))
    other = back(G.direction_features(cloud, turned, ["layer"], support, k=4), names)
    swapped = back(G.swapped(there), names)
    assert all(other[(k[0], k[2], k[1])] == pytest.approx(v) for k, v in swapped.items())
    twice = back(G.swapped(G.swapped(there)), names)
    assert all(v == pytest.approx(twice[k]) for k, v in back(there, names).items())


def test_sections_swap(cloud, edges, support):
    names = [s.split()[0] for s in G.SECTION]
    there = G.sectional_features(cloud, edges, ["layer"], support, k=6)
    turned = edges.select("layer", F.col("v").alias("u"), F.col("u").alias("v"))
    other = back(G.sectional_features(cloud, turned, ["layer"], support, k=6), names)
    assert all(other[(k[0], k[2], k[1])] == pytest.approx(v) for k, v in back(G.swapped(there), names).items())


def test_sections_of_a_cross(spark):
    """Five points around each of two ends, spread 3, 2 and 1 along the axes: eigenvalues 9, 4 and 1 times one number."""
    around = [(3, 0, 0), (-3, 0, 0), (0, 2, 0), (0, -2, 0), (0, 0, 1), (0, 0, -1)]
    points = [(0, 10 * e + i, [100.0 * e + x, float(y), float(z)]) for e in (0, 1) for i, (x, y, z) in enumerate([(0, 0, 0), *around])]
    df = spark.createDataFrame(points, "s int, vec_id int, vec array<double>")
    edges = spark.createDataFrame([(0, 0, 10)], "s int, u int, v int")
    support = spark.createDataFrame([(0, 0, 10, 0.75), (0, 10, 0, 0.25)], "s int, source int, target int, support double")
    r = G.sectional_features(df, edges, ["s"], support, k=6).first()
    shape = ((9 - 4) / 14, (4 - 1) / 9, 36 ** (1 / 3) / 14)
    assert (r.anisotropy_u, r.planarity_mean, r.omnivariance_mean) == pytest.approx(shape) and r.anisotropy_mean == pytest.approx(shape[0])
    assert (r.anisotropy_apart, r.margin, r.apart_margin) == pytest.approx((0, 0.5, 0), abs=1e-9)
    assert (r.align_u, r.align_v, r.align_pair, r.mean_pair) == pytest.approx((1, 1, 1, shape[0]))


@pytest.mark.parametrize("f", [G.path_torsion, G.path_fractures, G.path_curvature, G.edge_thinness, G.dimension_phase, G.dropped_geodesics])
def test_path_features_have_a_row_an_edge(cloud, edges, f):
    df = f(cloud, edges, ["layer"], k=4)
    assert df.count() == edges.count() and all(np.isfinite([x for x in r[3:]]).all() for r in df.collect())


def test_tangents_and_spectra(cloud):
    t = G.tangent_turns(cloud.withColumn("all", F.lit(1)), ["all"], k=6, dims=2).collect()
    assert len(t) == 24 and all(len(r.angles) == 1 and 0 <= r.angles[0] <= np.pi / 2 for r in t)
    assert all(len(r.vec) == 3 for r in G.spectral_embedding(cloud, ["layer"], 3, 5).collect())


def test_knn_in_blocks_is_knn(cloud):
    whole = V.knn(cloud, 5, ["layer"]).collect()
    parts = V.knn(cloud, 5, ["layer"], block=5).collect()
    key = lambda rows: sorted((r.layer, r.id, r.rank, r.neighbour, round(r.distance, 9)) for r in rows)
    assert key(whole) == key(parts)
    for r in whole:
        assert r.distance > 0 and r.id != r.neighbour


def test_projection_keeps_distances(cloud):
    p = V.project(cloud, 5, ["layer"])
    x = {(r.layer, r.vec_id): np.array(r.vec) for r in cloud.collect()}
    y = {(r.layer, r.vec_id): np.array(r.vec) for r in p.collect()}
    for k in range(1, 24):
        assert np.linalg.norm(x[(0, 0)] - x[(0, k)]) == pytest.approx(np.linalg.norm(y[(0, 0)] - y[(0, k)]))
    var = np.var([y[(0, k)] for k in range(24)], axis=0)
    assert (np.diff(var) <= 1e-9).all()


def test_local_participation_ratio(cloud):
    n = V.knn(cloud, 6, ["layer"])
    got = {(r.layer, r.id): r.ratio for r in V.local_participation_ratio(n, cloud, ["layer"]).collect()}
    x = {r.vec_id: np.array(r.vec) for r in cloud.where("layer = 0").collect()}
    near = [x[r.neighbour] for r in n.where("layer = 0 and id = 3").collect()]
    lam = np.linalg.eigvalsh(np.cov(np.array(near).T))
    assert got[(0, 3)] == pytest.approx(lam.sum() ** 2 / (lam**2).sum())


def test_zigzag_and_axes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    tri = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "u long, v long")
    more = tri.unionByName(spark.createDataFrame([(2, 3)], "u long, v long"))
    r = T.zigzag(tri, more, nodes).first()
    assert (r["first"], r["second"], r["union"], r["long"]) == (1, 1, 1, 1)
    pairs = spark.createDataFrame([(i, j, float(i + j), float(i * j)) for i in range(4) for j in range(i + 1, 4)], "u long, v long, distance double, support double")
    got = T.two_axis_connectivity(tri, pairs, nodes, [0.2, 0.6, 1.0], [0.0, 0.5]).collect()
    assert len(got) == 3 and all(r.two_axis <= r.one_axis + 1e-9 for r in got)
    f = T.directed_flags(spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")).first()
    assert tuple(f) == (3, 1)


def test_maps(spark, cloud):
    q, _ = np.linalg.qr(np.random.default_rng(9).normal(size=(5, 5)))
    a = cloud.where("layer = 0").select("vec_id", "vec")
    b = spark.createDataFrame([(r.vec_id, (np.array(r.vec) @ q).tolist()) for r in a.collect()], "vec_id long, vec array<double>")
    pairs = A.paired(a, b)
    m = np.zeros((5, 5))
    for r in A.procrustes_map(pairs).collect():
        m[r.i, r.j] = r.value
    assert np.allclose(m, q) and A.procrustes_error(pairs).first().rmse == pytest.approx(0, abs=1e-6)
    assert A.linear_cka(pairs).first().cka == pytest.approx(1.0)
    assert [r.rho for r in A.canonical_correlations(pairs, reg=1e-9).collect()] == pytest.approx([1.0] * 5)
    charted = pairs.withColumn("chart", F.col("id") % 2)
    maps = A.chart_maps(charted, "chart", 5)
    moved = A.apply_maps(charted.select("id", "chart", F.col("x").alias("vec")), maps, "chart").collect()
    want = {r.id: r.y for r in pairs.collect()}
    assert len(moved) == 24 and np.mean([np.linalg.norm(np.array(r.vec) - want[r.id]) for r in moved]) < 2.0


def test_matching_and_retrieval(spark):
    s = spark.createDataFrame([(i, j, float(-abs(i - j))) for i in range(4) for j in range(4)], "i long, j long, score double")
    assert A.top1_retrieval(s).first().top1 == 1.0 and A.cycle_return(s, s, s).first().rate == 1.0
    cost = s.select(F.lit(0).alias("k"), "i", "j", (-F.col("score")).alias("cost"))
    r = A.transport(cost, ["k"]).first()
    assert r.matched_cost == 0.0 and r.monotone == pytest.approx(1.0)


def test_perturbations(spark):
    v = spark.createDataFrame([(m, [float(m), 1.0, -float(m)]) for m in range(4)], "module long, vec array<double>")
    specs = A.perturbations(v, 2)
    assert specs.count() == 6
    out = A.perturbed(v, specs, [0.0, 1.0])
    assert out.count() == 4 * 6 * 2
    still = out.where("strength = 0").join(v.withColumnRenamed("vec", "was"), "module").where("vec <> was")
    assert still.count() == 0
    t = A.transition_matrix(v)
    assert all(x == pytest.approx(1.0) for (x,) in t.groupBy("i").agg(F.sum("p")).select("sum(p)").collect())
    moved = A.response(t, A.transition_matrix(out, ["spec", "strength"]), ["spec", "strength"])
    assert {r.response > 0 for r in moved.where("strength = 0").collect()} == {False}


def test_warp_and_codebook(spark, cloud):
    layers = spark.createDataFrame([(layer, m, [float(m), float(layer)]) for layer in (0, 1) for m in range(3)], "layer int, module int, vec array<double>")
    target = layers.where("layer = 1").select("module", "vec")
    got = {r.warp: r.cost for r in A.depth_warp(layers, target, [[1.0, 0.0], [0.0, 1.0]]).collect()}
    assert got[1] == pytest.approx(0.0) and got[0] > 0.5
    tokens = A.codebook(cloud.where("layer = 0"), 4)
    assert tokens.count() == 24 and tokens.select("token").distinct().count() <= 4
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    assert A.descriptor_similarity(d, d).first().similarity == 1.0
