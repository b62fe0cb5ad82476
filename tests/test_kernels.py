"""Dense kernels against brute force and known shapes."""

import itertools

import numpy as np
import pytest

from orrery.operators import kernels as K


@pytest.fixture
def cloud():
    return np.random.default_rng(3).normal(size=(30, 4))


def test_geodesics(cloud):
    d = K.pairwise(cloud)
    w = K.connect(K.knn_adjacency(d, 3), d)
    g, before = K.shortest_paths(w)
    assert (g >= d - 1e-9).all() and np.allclose(g, g.T) and (g[:, :, None] + g[None] >= g[:, None, :] - 1e-9).all()
    for a, b in itertools.product(range(0, 30, 7), repeat=2):
        if a != b:
            way = K.path(before, a, b)
            assert way[0] == a and way[-1] == b
            assert sum(w[x, y] for x, y in itertools.pairwise(way)) == pytest.approx(g[a, b])


def test_connect_adds_the_shortest_bridges():
    p = np.array([[0.0], [1.0], [10.0], [11.0], [30.0]])
    d = K.pairwise(p)
    w = K.connect(K.knn_adjacency(d, 1), d)
    assert w[1, 2] == 9 and len(np.unique(K.labels_of(np.isfinite(w)))) == 1


def test_circle_has_one_bar():
    t = np.arange(20) * 2 * np.pi / 20
    bars = K.rips_h1(K.pairwise(np.c_[np.cos(t), np.sin(t)]))
    life = bars[:, 1] - bars[:, 0]
    assert (life > 0.5).sum() == 1 and life.max() == pytest.approx(np.sqrt(3) - 2 * np.sin(np.pi / 20), abs=0.15)
    assert len(K.rips_h1(K.pairwise(np.arange(6.0)[:, None]))) == 0


def test_assignment(cloud):
    cost = np.abs(cloud[:6, :1] - cloud[6:13, :1].T)
    best = min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(7), 6))
    m = K.assignment(cost)
    assert len(set(m.tolist())) == 6 and cost[np.arange(6), m].sum() == pytest.approx(best)


def test_transport_marginals(cloud):
    plan = K.sinkhorn(K.pairwise(cloud), 0.5)
    assert plan.sum(1) == pytest.approx(np.full(30, 1 / 30)) and plan.sum(0) == pytest.approx(np.full(30, 1 / 30), rel=1e-3)
    d = K.pairwise(cloud[:12])
    t, loss = K.gromov_wasserstein(d, d, np.eye(12) / 12)
    assert loss < 0.5 and np.trace(t) > 0.5


def test_procrustes(cloud):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(4, 4)))
    assert np.allclose(K.procrustes(cloud, cloud @ q), q)
    m = cloud.T @ cloud
    r = K.inverse_root(m)
    assert np.allclose(r @ m @ r, np.eye(4), atol=1e-6)


def test_zigzag_and_betti():
    tri = {(0, 1), (1, 2), (0, 2)}
    got = K.zigzag_h1(4, tri, tri | {(2, 3)})
    assert (got["first"], got["second"], got["union"], got["long"]) == (1, 1, 1, 1)
    assert K.zigzag_h1(4, tri, {(2, 3)})["long"] == 0


def test_swaps_keep_degrees():
    rng = np.random.default_rng(5)
    e = np.array(sorted({tuple(sorted(x)) for x in rng.integers(0, 20, (60, 2)).tolist() if x[0] != x[1]}))
    new = K.double_edge_swaps(e, 20, rng.random((400, 3)))
    assert (np.bincount(e.ravel(), minlength=20) == np.bincount(new.ravel(), minlength=20)).all()
    assert len({tuple(sorted(x)) for x in new.tolist()}) == len(e) and (new[:, 0] != new[:, 1]).all()


def test_communities_of_two_cliques():
    a = np.zeros((10, 10), bool)
    a[:5, :5] = a[5:, 5:] = True
    a[4, 5] = a[5, 4] = True
    np.fill_diagonal(a, False)
    label = K.greedy_modularity(a)
    assert len(set(label[:5].tolist())) == 1 and len(set(label[5:].tolist())) == 1 and label[0] != label[9]
    label = K.propagated_labels(a, np.arange(10))  # may end in one community, never splits a clique
    assert len(set(label[:5].tolist())) == 1 and len(set(label[5:].tolist())) == 1


def test_minimum_tree(cloud):
    d = K.pairwise(cloud)
    tree = K.minimum_tree(d)
    assert len(tree) == 29
    adjacent = np.zeros((30, 30), bool)
    for a, b, _ in tree:
        adjacent[a, b] = adjacent[b, a] = True
    assert len(np.unique(K.labels_of(adjacent))) == 1


def test_logistic_and_auc():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    fold = np.arange(400) % 3
    assert K.cv_auc(x, y, fold) > 0.95
    c = K.logistic(x, y.astype(float), 0.05)
    assert c[0] > 0.5 and abs(c[1]) < 0.2 and abs(c[2]) < 0.2
    assert K.auc(np.array([1, 0, 1, 0]), np.array([3.0, 3, 2, 1])) == 0.625
    assert K.auc(np.array([1, 1]), np.array([3.0, 3])) is None and K.auc(np.array([1, 0]), np.array([2.0, 2])) == 0.5


def test_turning_of_a_straight_line():
    assert K.turning(np.c_[np.arange(5.0), np.zeros(5), np.zeros(5)]) == (0, 0, 0, 0)
    helix = np.array([[np.cos(t), np.sin(t), 0.3 * t] for t in np.arange(12) * 0.5])
    turn, _, torsion, signed = K.turning(helix)
    assert turn > 0.2 and torsion == pytest.approx(abs(signed)) and torsion > 0


def test_communities_from_edges_are_those_of_the_matrix():
    rng = np.random.default_rng(4)
    for n, part in ((1, 0.5), (25, 0.0), (40, 0.1), (60, 0.2), (80, 0.05)):
        adjacent = np.triu(rng.random((n, n)) < part, 1)
        adjacent |= adjacent.T
        m = adjacent.sum() / 2
        want = np.arange(n)
        if m:
            e, a = adjacent / (2 * m), adjacent.sum(1) / (2 * m)
            while True:
                gain = np.where((e > 0) & ~np.eye(n, dtype=bool), 2 * (e - np.outer(a, a)), -np.inf)
                i, j = np.unravel_index(gain.argmax(), gain.shape)
                if not gain[i, j] > 1e-12:
                    break
                e[i] += e[j]
                e[:, i] += e[:, j]
                e[j] = e[:, j] = 0
                a[i] += a[j]
                want[want == j] = i
        assert (K.merged_communities(n, *np.nonzero(np.triu(adjacent))) == want).all()


def test_tree_and_gap_without_a_matrix():
    rng = np.random.default_rng(6)
    p = rng.standard_normal((130, 5))
    assert np.sort(K.tree_lengths(p)) == pytest.approx(np.sort([w for _, _, w in K.minimum_tree(K.pairwise(p))]))
    near = np.isfinite(K.knn_adjacency(K.pairwise(p), 6)) & ~np.eye(130, dtype=bool)
    u, v = np.nonzero(np.triu(near))
    r = 1 / np.sqrt(near.sum(1))
    want = np.sort(np.linalg.eigvalsh(np.eye(130) - r[:, None] * near * r[None]))[1]
    assert K.spectral_gap(130, u, v) == pytest.approx(want, abs=1e-9) == K.spectral_gap(130, u, v, dense=10, width=25)
    apart = (np.r_[u, u + 130], np.r_[v, v + 130])
    assert K.spectral_gap(260, *apart, dense=10) == 0 == pytest.approx(K.spectral_gap(260, *apart), abs=1e-9)
