"""Paths, forests and bridges in rounds against plain Python."""

import heapq
import random

import numpy as np
import pytest

from orrery.operators import kernels as K
from orrery.operators import paths, vectors

KEYS = ["s"]


def dijkstra(edges, source):
    near, done, heap = {}, {}, [(0.0, source)]
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    while heap:
        d, x = heapq.heappop(heap)
        if x not in done:
            done[x] = d
            for y, w in near.get(x, []):
                heapq.heappush(heap, (d + w, y))
    return done


@pytest.mark.parametrize("width", [0.1, 4.0, 1e9])
def test_shortest_paths(spark, width):
    rng = random.Random(width)
    edges, pairs = [], []
    for s in (0, 1):
        e = [(a, b, rng.choice([0.0, 1.0, 1.0, rng.random() * 5])) for _ in range(140) for a, b in [(rng.randrange(60), rng.randrange(60))]]
        e += [(70, 71, 2.0), (71, 70, 1.0), (72, 72, 0.0)]  # apart, parallel, a loop
        edges += [(s, *x) for x in e]
        pairs += [(s, rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(s, 70, 71), (s, 70, 3), (s, 72, 72), (s, 99, 1)]
    got = paths.shortest(spark.createDataFrame(edges, "s int, u int, v int, w double"), spark.createDataFrame(pairs, "s int, source int, target int"), KEYS, width).collect()
    assert len(got) == len(set(pairs))
    for r in got:
        want = dijkstra([x[1:] for x in edges if x[0] == r.s], r.source).get(r.target)
        assert (r.distance is None) == (want is None) and (want is None or r.distance == pytest.approx(want, abs=1e-12))


def kruskal(edges):
    part, out = {}, set()

    def top(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges if u != v):
        if top(u) != top(v):
            part[top(u)] = top(v)
            out.add((u, v, w))
    return out


def test_spanning_forest_and_its_bars(spark):
    rng = random.Random(3)
    edges = [(s, rng.randrange(80), rng.randrange(80), float(rng.randrange(5))) for s in (0, 1, 2) for _ in range(90 + 60 * s)]
    df = spark.createDataFrame(edges, "s int, u int, v int, w double")
    forest = paths.spanning_forest(df, KEYS)
    for s in (0, 1, 2):
        assert {(r.u, r.v, r.w) for r in forest.where(f"s = {s}").collect()} == kruskal([x[1:] for x in edges if x[0] == s])
    nodes = spark.createDataFrame([(s, i) for s in (0, 1, 2, 3) for i in range(80)], "s int, node int")
    bars = paths.zero_bars(forest, nodes, KEYS).collect()
    for s in (0, 1, 2, 3):
        own = [b.death for b in bars if b.s == s]
        assert len(own) == 80 and sorted(d for d in own if d is not None) == sorted(w for _, _, w in kruskal([x[1:] for x in edges if x[0] == s]))
    assert paths.spanning_forest(df.limit(0), KEYS).count() == 0


def test_bridges_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(2)
    clouds = {s: np.concatenate([rng.standard_normal((n, 3)) + 8 * rng.standard_normal(3) for n in sizes]) for s, sizes in enumerate(([9, 9, 7], [20], [6, 6, 6, 6]))}
    df = spark.createDataFrame([(s, i, v.tolist()) for s, p in clouds.items() for i, v in enumerate(p)], "s int, vec_id int, vec array<double>")
    got = paths.neighbour_graph(df, 4, KEYS)
    for s, p in clouds.items():
        d = K.pairwise(p)
        w = K.connect(K.knn_adjacency(d, 4), d)
        want = {(i, j): w[i, j] for i in range(len(p)) for j in range(i + 1, len(p)) if np.isfinite(w[i, j])}
        own = {(r.u, r.v): r.w for r in got.where(f"s = {s}").collect()}
        assert own.keys() == want.keys() and all(own[k] == pytest.approx(want[k]) for k in own)
    pairs = df.alias("a").join(df.alias("b"), "s").where("a.vec_id < b.vec_id").selectExpr("s", "a.vec_id u", "b.vec_id v")
    for r in paths.edge_geodesics(df, pairs, KEYS, 4).collect():
        d = K.pairwise(clouds[r.s])
        if r.u == 0:
            assert r.geodesic == pytest.approx(K.shortest_paths(K.connect(K.knn_adjacency(d, 4), d))[0][r.u, r.v]) and r.euclidean == pytest.approx(d[r.u, r.v])
    assert vectors.pairs(df, KEYS).count() == pairs.count()
