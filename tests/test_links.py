"""Shortest paths from some nodes at a time against those of all pairs."""

import numpy as np
import pytest

from orrery.operators import kernels as K


def test_distances_and_ways_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    p = np.round(rng.standard_normal((60, 2)), 1)  # equal ways and lengths
    d = K.pairwise(p)
    w = K.knn_adjacency(d, 3)
    g, before = K.shortest_paths(w)
    u, v = np.nonzero(np.triu(np.isfinite(w), 1))
    links = K.Links(60, u, v, w[u, v])
    some = np.array([0, 7, 31, 59])
    rows = links.distances(some, width=3)
    ok = np.isfinite(g[some])
    assert (np.isfinite(rows) == ok).all() and rows[ok] == pytest.approx(g[some][ok])
    hops = [(len(links.way(rows[i], a, b)), len(K.path(before, a, b))) for i, a in enumerate(some.tolist()) for b in range(60) if ok[i, b] and g[a, b] > 1e-9]
    assert len(hops) > 100 and np.mean([x == y for x, y in hops]) > 0.97  # a rounded sum may tie in one and not in the other


def test_distances_take_memory_of_edges_and_rows_alone():
    import tracemalloc

    n = 20000  # all pairs would be 3.2 GB
    u = np.arange(n)
    links = K.Links(n, np.r_[u, u], np.r_[(u + 1) % n, (u * 7 + 3) % n], np.ones(2 * n))
    tracemalloc.start()
    rows = links.distances(np.arange(16))
    assert rows.shape == (16, n) and np.isfinite(rows).all() and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
