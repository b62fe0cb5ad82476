"""What each null mechanism keeps and what it changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import random as R
from orrery.operators import relational as L
from orrery.operators import selection as P
from orrery.plans import nulls as N


@pytest.fixture
def rows(spark):
    df = spark.range(40).select("id", (F.col("id") % 2).alias("k"), (F.col("id") % 4).alias("s"), (F.col("id") * 1.5 + 1).alias("x"), (F.col("id") * -2.0).alias("y"))
    return R.replicates(df, 2)


def bags(df, by, col):
    return {tuple(r)[:-1]: tuple(r)[-1] for r in df.groupBy(*by).agg(F.array_sort(F.collect_list(col))).collect()}


def test_families():
    assert len(N.MECHANISM) == 140 and N.MECHANISM["feature_shuffle"] == "columns" and N.MECHANISM["degree_rewire"] == "rewire"


def test_permutations(rows):
    by = ["perm_idx", "k", "s"]
    m = N.permutation(rows, ["x", "y"], "id", "n", "perm_idx", ["k"], ["s"])
    assert bags(m, by, "x") == bags(rows, by, "x") and m.where("y <> -2.0 * (x - 1) / 1.5").count() == 0
    assert m.join(rows.select("id", "perm_idx", F.col("x").alias("was")), ["id", "perm_idx"]).where("x <> was").count() > 0
    c = N.columns(rows, ["x", "y"], "id", "n", "perm_idx", ["k"])
    assert bags(c, ["perm_idx", "k"], "y") == bags(rows, ["perm_idx", "k"], "y") and c.where("abs(y + 2.0 * (x - 1) / 1.5) > 1e-9").count() > 0


def test_signs_and_swaps(rows):
    assert N.sign(rows, ["x"], "id", "n", "perm_idx").select(F.abs("x").alias("x")).exceptAll(rows.select("x")).count() == 0
    once = N.swap(rows, [("x", "y")], "id", "n", "perm_idx", ["s"])
    assert N.swap(once, [("x", "y")], "id", "n", "perm_idx", ["s"]).exceptAll(rows).count() == 0 and once.exceptAll(rows).count() > 0
    d = N.draw(rows, ["x"], "id", "n", "perm_idx")
    assert d.count() == rows.count() and d.select("x").distinct().count() < 40


def test_orders_and_bases(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0, 4.0]), (2, 0, [5.0, 6.0, 7.0, 8.0])], "id int, perm_idx int, v array<double>")
    shared = {r.id: r.v for r in N.order(df, "v", "id", "n", "perm_idx", shared=True).collect()}
    assert sorted(shared[1]) == [1, 2, 3, 4] and [x - 4 for x in shared[2]] == shared[1]
    dims = {r.id: r.v for r in N.dimensions(df, "v", "n", "perm_idx").collect()}
    assert sorted(map(abs, dims[1])) == [1, 2, 3, 4]
    turned = {r.id: r.v for r in N.basis(df, "v", 4, "n", 0).collect()}
    assert np.linalg.norm(turned[1]) == pytest.approx(np.sqrt(30)) and np.dot(turned[1], turned[2]) == pytest.approx(70)


def test_relabel_keeps_bins(rows):
    r = N.relabel(rows, "id", "x", "n", "perm_idx", ["k"])
    assert bags(r, ["perm_idx"], "id") == bags(r, ["perm_idx"], "id_perm") and r.where("id <> id_perm").count() > 0


def test_exchange(spark):
    df = spark.createDataFrame([(n, layer, 0, float(10 * n + layer)) for n in range(20) for layer in (0, 1)], "node int, layer int, perm_idx int, v double")
    out = N.exchange(df, "v", "node", "layer", "n", "perm_idx")
    assert bags(out, ["node"], "v") == bags(df, ["node"], "v") and 0 < out.join(df.select("node", "layer", F.col("v").alias("w")), ["node", "layer"]).where("v <> w").count() < 40


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0), ("b", 3, 5.0), ("b", 4, 1.0)], "k string, i int, x double")
    with pytest.raises(ValueError, match="repeat"):
        L.one_to_one_join(df, df, ["k"])
    assert L.one_to_one_join(df, df.select("i", F.col("x").alias("z")), ["i"]).count() == 4
    assert {(r.k, r.i) for r in L.top_row(df, "x", ["k"], "i").collect()} == {("a", 2), ("b", 3)}
    assert [r[0] for r in df.select(L.digitize(F.col("x"), [1.0, 2.0])).collect()] == [1, 2, 2, 0]
    assert L.histogram_gap(df.withColumn("bin", F.col("i") % 2), df.withColumn("bin", F.lit(1))).first().gap == 1.0
    t = spark.createDataFrame([(float(i), int(i >= 8)) for i in range(16)], "s double, y int")
    r = L.bin_trend(t, "s", "y").first()
    assert r.delta == 1.0 and r.slope > 0 and L.bin_trend(t.limit(5), "s", "y").first().slope is None


def test_selection(spark):
    df = spark.range(30).select("id", (F.col("id") < 6).alias("hot"), (F.col("id") % 3).alias("bin"), (F.col("id") % 2).alias("y"))
    got = P.matched_controls(df, "hot", "id", "bin", "y").collect()
    assert len(got) == 6 and all(r.control >= 6 and r.control % 3 == r.hot % 3 and r.control % 2 == r.hot % 2 for r in got)
    e = spark.createDataFrame([("a", "x", "t1"), ("a", "y", "t1"), ("a", "z", "t2"), ("b", "x", "t3")], "source string, target string, token string")
    assert [tuple(r) for r in P.mapped_nodes(e, 1).collect()] == [("a", "t1", 3)]
    loop = spark.createDataFrame([(1, 1), (1, 2)], "source int, target int")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    out = P.redrawn_targets(loop, nodes).collect()
    assert len(out) == 2 and all(r.source != r.target for r in out)

    assert P.bundle(e.withColumn("label", F.lit(1)), 5, 10).count() == 0
