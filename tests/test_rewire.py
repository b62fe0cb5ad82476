"""Rewiring in rounds: what it keeps and what it moves."""

import random
from collections import Counter

import pytest

from orrery.operators import rewire


def graphs(seed=1):
    rng = random.Random(seed)
    out = []
    for s, (n, m) in enumerate(((60, 200), (200, 300), (4, 2))):
        e = set()
        while len(e) < m:
            u, v = rng.randrange(n), min(n - 1, int(rng.expovariate(8 / n)))
            if u != v:
                e.add((min(u, v), max(u, v)))
        out += [(s, *x) for x in e]
    return out


def degrees(rows):
    return Counter(x for s, u, v in rows for x in ((s, u), (s, v)))


def test_degrees_stay_and_edges_move(spark):
    rows = graphs()
    df = spark.createDataFrame(rows, "s int, u int, v int")
    got = [tuple(r) for r in rewire.rewired(df, ["s"]).collect()]
    assert len(got) == len(set(got)) == len(rows) and all(u < v for _, u, v in got)
    assert degrees(got) == degrees(rows)
    assert len(set(got) & {x for x in rows if x[0] == 1}) < 0.1 * 300
    assert len(set(got) & {x for x in rows if x[0] == 0}) < 0.35 * 200  # a dense graph shares edges by chance
    assert sorted(got) == sorted(tuple(r) for r in rewire.rewired(df, ["s"]).collect())
    other = [tuple(r) for r in rewire.rewired(df, ["s"], salt="again").collect()]
    assert degrees(other) == degrees(rows) and set(other) != set(got)


def test_strata_keep_their_edges(spark):
    rows = [x for x in graphs(2) if x[0] == 1]
    kind = lambda u, v: (u // 20 + v // 20) % 3
    strata = [(1, u, v, kind(u, v)) for u in range(200) for v in range(u + 1, 200) if kind(u, v) < 2]
    df = spark.createDataFrame(rows, "s int, u int, v int")
    got = [tuple(r) for r in rewire.rewired(df, ["s"], 8, strata=spark.createDataFrame(strata, "s int, u int, v int, stratum int")).collect()]
    count = lambda e: Counter(min(2, kind(u, v)) for _, u, v in e)
    assert count(got) == count(rows) and degrees(got) == degrees(rows)
    assert len(set(got) & set(rows)) < 0.6 * len(rows)


@pytest.mark.parametrize("rows", [[], [(0, 1, 2)], [(0, 1, 1)]])
def test_nothing_to_swap(spark, rows):
    got = rewire.rewired(spark.createDataFrame(rows, "s int, u int, v int"), ["s"], 2).collect()
    assert [tuple(r) for r in got] == [x for x in rows if x[1] != x[2]]
