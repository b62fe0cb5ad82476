"""Statistics and graph operators on fixtures small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import expressions as X
from orrery.functions import random as R
from orrery.functions import stats as S
from orrery.operators import graph, models, sequences, support, topology
from orrery.plans import audit, screen


def one(df):
    return df.first()[0]


def column(spark, expr):
    return spark.range(1).select(expr).first()[0]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_auc_and_guards(spark):
    df = frame(spark, [("a", 1, 3.0), ("a", 0, 3.0), ("a", 1, 2.0), ("a", 0, 1.0), ("b", 1, 1.0), ("c", 1, 2.0), ("c", 0, 2.0), ("d", 1, float("nan")), ("d", 0, 1.0)], "k string, y int, s double")
    got = {r.k: r.auc for r in S.auc(df, "y", "s", ["k"]).collect()}
    assert got == {"a": 0.625, "b": None, "c": 0.5, "d": None}
    flipped = {r.k: r.auc for r in S.auc(df.withColumn("s", -F.col("s")), "y", "s", ["k"]).collect()}
    assert flipped["a"] == pytest.approx(1 - 0.625)


def test_empirical_p(spark):
    df = frame(spark, [(1.0, 0.0), (1.0, 1.0), (1.0, 2.0), (1.0, float("nan"))], "o double, x double")
    assert one(df.agg(S.upper_tail_p(F.col("x"), F.col("o")))) == 0.75
    assert one(df.agg(S.lower_tail_p(F.col("x"), F.col("o")))) == 0.75
    assert one(df.where("isnan(x)").agg(S.upper_tail_p(F.col("x"), F.col("o")))) is None


def test_fisher(spark):
    df = frame(spark, [(1 / 21,)] * 3 + [(float("nan"),)], "p double")
    r = df.agg(S.fisher_stat("p").alias("x"), S.fisher_p("p").alias("p")).first()
    assert r.x == pytest.approx(18.26713462634054) and r.p == pytest.approx(0.005598163615730098)


def test_quantile_ranks_and_bins(spark):
    df = frame(spark, [(x,) for x in (0.0, 1.0, 2.0, 3.0)], "x double")
    assert one(df.agg(S.quantile("x", 0.95))) == pytest.approx(2.85)
    t = frame(spark, [(1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0)], "i int, x double")
    got = [tuple(r) for r in t.select("i", S.rank_share("x"), S.rank_bins("x", 2)).orderBy("i").collect()]
    assert got == [(1, 0.375, 0), (2, 0.375, 0), (3, 0.75, 1), (4, 1.0, 1)]


def test_spearman(spark):
    df = frame(spark, [("a", 1.0, 1.0), ("a", 2.0, 8.0), ("a", 3.0, 27.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.rho for r in S.spearman(df, "x", "y", ["k"]).collect()}
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0 and got["c"] is None


def test_expressions(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert column(spark, X.cosine(v(1, 0), v(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert column(spark, X.cosine(v(0, 0), v(1, 1))) == 0.0
    assert column(spark, X.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0.0
    assert column(spark, X.triangle_slack(F.lit(2.0), F.lit(3.0), F.lit(4.0))) == 0.5
    assert column(spark, X.entropy(v(1, 1, -5))) == pytest.approx(math.log(2))
    assert column(spark, X.sign_changes(v(0, 1, 0, 1, 1))) == 2
    assert column(spark, X.logit(F.lit(0.5))) == 0.0
    assert column(spark, X.angle_degrees(v(1, 0), v(-1, 0))) == pytest.approx(0.0)
    assert column(spark, X.normal_llr(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(0.5)
    assert column(spark, X.pair_features(v(1, 2), v(3, 1))) == [1, 2, 3, 1, 2, 1, 3, 2]


def test_permutations_keep_strata(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("s"), (F.col("id") * 7 % 5).alias("y"))
    moved = R.permuted(R.replicates(df, 3), ["y"], "id", "salt", ["s"], "perm_idx")
    a = moved.groupBy("perm_idx", "s").agg(F.array_sort(F.collect_list("y")).alias("x"), F.array_sort(F.collect_list("y_perm")).alias("z"))
    assert all(r.x == r.z for r in a.collect()) and moved.where("y <> y_perm").count() > 0
    boot = R.resampled(df, ["y"], "id", "b", ["s"])
    assert boot.count() == 60
    assert R.sample(df, 5, "id", "q", ["s"]).count() == 15
    assert {r["fold"] for r in R.folds(df, 3, "id", "s", "f").collect()} == {0, 1, 2}


PENDANT = [(0, 1), (1, 2), (0, 2), (0, 3)]


def test_small_graph(spark):
    e = graph.undirected(frame(spark, [*PENDANT, (1, 0), (2, 2)], "source long, target long"))
    assert e.count() == 4
    got = {r.node: r.clustering for r in graph.local_clustering(e).collect()}
    assert got == {0: pytest.approx(1 / 3), 1: 1.0, 2: 1.0, 3: 0.0}
    assert {(r.u, r.v): r.curvature for r in graph.forman_curvature(e).collect()}[(0, 1)] == -1
    assert {r.node: r.open_pairs for r in graph.open_pairs(e).collect()} == {0: 2, 1: 0, 2: 0, 3: 0}
    assert {(r.u, r.v): r.hops for r in graph.hop_distances(e, 3).collect()}[(3, 2)] == 2


def test_cycle_rank(spark):
    rows = [("t", 0, 1), ("t", 1, 2), ("t", 0, 2), ("p", 0, 1), ("p", 1, 2), ("w", 0, 1), ("w", 1, 2), ("w", 0, 2), ("w", 3, 4), ("w", 4, 5), ("w", 3, 5)]
    got = {r.k: (r["rank"], r.n_components) for r in graph.cycle_rank(frame(spark, rows, "k string, u long, v long"), ["k"]).collect()}
    assert got == {"t": (1, 1), "p": (0, 1), "w": (2, 2)}


def motifs(df):
    return {tuple(r.nodes) for r in df.collect()}


def test_motifs(spark):
    g = lambda *e: frame(spark, list(e), "source string, target string")
    assert motifs(graph.feed_forward_loops(g(("a", "b"), ("b", "c"), ("a", "c")))) == {("a", "b", "c")}
    assert motifs(graph.chains(g(("a", "b"), ("b", "c"), ("a", "c")))) == set()
    assert motifs(graph.feedback_triads(g(("a", "b"), ("b", "c"), ("c", "a")))) == {("a", "b", "c")}
    assert motifs(graph.bifans(g(("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))) == {("a", "b", "x", "y")}
    assert motifs(graph.multi_inputs(g(("a", "t"), ("b", "t")))) == {("a", "b", "t")}
    panel = graph.motif_panel(g(("a", "b"), ("b", "c"), ("a", "c")))
    assert {r.kind for r in panel.collect()} == {"feed_forward"}


def test_information_content(spark):
    t = frame(spark, [("a", "x"), ("b", "y"), ("c", "y")], "symbol string, term string")
    assert {r.term: r.ic for r in support.information_content(t).collect()}["x"] == pytest.approx(math.log(2))


def test_split_masks(spark):
    e = frame(spark, [(i, 10 * i) for i in (1, 2, 3, 4)], "u long, v long")
    got = {}
    for r in screen.split_masks(e).collect():
        got.setdefault(r.split, set()).add(r.u)
    assert got == {"source_disjoint": {1, 2}, "target_disjoint": {3, 4}}


def test_top_nodes_ties(spark):
    e = frame(spark, [("b", "a"), ("b", "a"), ("c", "d")], "source string, target string")
    assert [r.node for r in graph.top_nodes(e, 1).collect()] == ["a"]


def test_dwell_segments(spark):
    t = frame(spark, [(1, i + 1, x) for i, x in enumerate("110220")], "user_id int, pos int, token string")
    got = [(r.token, r.length, r.dwell) for r in sequences.segments(t).orderBy("seg").collect()]
    assert got == [("1", 2, 1), ("0", 1, 0), ("2", 2, 1), ("0", 1, 0)]


def test_strict_margin_against_pooled_gap(spark):
    res = frame(spark, [("s", 0.2)], "k string, delta double")
    nulls = lambda a, b: frame(spark, [("s", "A", 0.1)] * a + [("s", "B", 0.3)] * b, "k string, null_kind string, null_value double")
    for n, pooled in ((nulls(50, 50), -0.1), (nulls(99, 1), 0.1)):
        assert audit.pooled_gap(res, n, ["k"]).first().null_gap == pytest.approx(pooled)
        r = audit.strict_audit(res, n, ["k"], ["A", "B"]).first()
        assert r.strict_margin == pytest.approx(-0.1) and r.strict_positive == 0


def test_decision_history_and_gate(spark):
    s = frame(spark, [(i, j, f, d) for i in range(10) for j, f, d in ((0, "geo", "negative"), (1, "top", "promising"))], "iteration int, id int, family string, decision string")
    shown, weak = audit.decision_history(s)
    assert shown.count() == 16 and [(r.family, r.n_weak) for r in weak.collect()] == [("geo", 8)]
    g = audit.gate(frame(spark, [(True, True), (True, None)], "a boolean, b boolean"), ["a", "b"])
    assert sorted((r.passed, tuple(r.failed_checks)) for r in g.collect()) == [(False, ("b",)), (True, ())]
    assert audit.next_iteration(frame(spark, [("iter_0007",), ("x",)], "name string")).first()[0] == 8


def test_rewiring_keeps_degrees(spark):
    e = frame(spark, [("k", i, (i * 5 + d) % 23) for i in range(23) for d in (1, 2)], "k string, source long, target long")
    e = graph.undirected(e, ["k"])
    new = models.rewired(e, ["k"])
    deg = lambda x: {(r.node, r.degree) for r in graph.degrees(x, ["k"]).collect()}
    assert deg(e) == deg(new) and e.exceptAll(new).count() > 0 and new.distinct().count() == e.count()


def test_trajectory_shape(spark):
    r = topology.trajectory_shape(frame(spark, [([0, 0, 1, 1],)], "trajectory array<int>")).first()
    assert (r.area, r.onset, r.rise, r.roughness) == (0.5, 2, 1.0, 1.0) and r.slope == pytest.approx(0.4)
