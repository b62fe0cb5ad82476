"""The pivot index against comparing all with all, and how much of it that is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import pivots, vectors


def cloud(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s, (parts, each) in enumerate(((30, 40), (1, 300), (1, 3))):
        for c in range(parts):
            centre = 20 * rng.standard_normal(6)
            rows += [(s, 1000 * c + i, (centre + rng.standard_normal(6)).tolist()) for i in range(each)]
    rows += [(1, 5000 + i, rows[1210][2]) for i in range(150)]  # one point very often
    return spark.createDataFrame(rows, "s int, vec_id long, vec array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_are_those_of_all_pairs(spark, metric):
    df = cloud(spark)
    a, b = pivots.knn(df, 5, ["s"], metric=metric, block=32), vectors.knn(df, 5, ["s"], metric=metric)
    got, want = ({(r.s, r.id, r["rank"]): (r.neighbour, r.distance) for r in x.collect()} for x in (a, b))
    assert got.keys() == want.keys()
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in got)
    if metric == "euclidean":  # cosines of equal points differ in their last bits by the order of sums
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_few_blocks_are_looked_at_where_points_lie_in_clumps(spark):
    df = cloud(spark).where("s = 0")
    rows, p = pivots.assigned(df, ["s"], "vec_id", "euclidean", 32)
    _, _, more = pivots.candidates(rows, p, 5, ["s"], "euclidean", 32)
    n_blocks = p.count()
    assert n_blocks > 20 and more.count() < 0.2 * df.count() * n_blocks


def test_without_keys_and_of_nothing(spark):
    df = cloud(spark).where("s = 1").select("vec_id", "vec")
    got = pivots.knn(df, 3, block=64).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    assert got.where("n <> 3").count() == 0 and got.count() == 450
    assert pivots.knn(df.limit(0), 3).count() == 0
