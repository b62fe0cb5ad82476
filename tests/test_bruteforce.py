"""Queries that SQL does not say, against plain Python over the raw tables."""

import heapq
import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from orrery import queries as queries_module
from orrery import registry as Q

Q.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud():
    """(label, layer) -> ids and points; and all points by (id, layer)."""
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    slices, every = defaultdict(list), {}
    for i, label, e in sorted(zip(t["vec_id"], t["label"], t["embedding"], strict=True)):
        for layer in range(4):
            v = np.array(e[16 * layer : 16 * layer + 16], float)
            slices[label, layer].append((i, v))
            every[i, layer] = v
    return {k: ([i for i, _ in v], np.array([x for _, x in v])) for k, v in slices.items()}, every


def neighbour_graph(p, k):
    """node -> {neighbour: length}: each node's k nearest, both ways; components joined by their shortest gap."""
    n = len(p)
    d = [[math.dist(a, b) for b in p] for a in p]
    g = defaultdict(dict)
    for i in range(n):
        for j in sorted((j for j in range(n) if j != i), key=lambda j: (d[i][j], j))[:k]:
            g[i][j] = g[j][i] = d[i][j]
    while True:
        seen, todo = {0}, [0]
        while todo:
            for j in g[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        if len(seen) == n:
            return g, d
        i, j = min(((i, j) for i in seen for j in range(n) if j not in seen), key=lambda e: d[e[0]][e[1]])
        g[i][j] = g[j][i] = d[i][j]


def geodesics(g, n):
    out = np.full((n, n), math.inf)
    for s in range(n):
        heap = [(0.0, s)]
        while heap:
            x, i = heapq.heappop(heap)
            if x < out[s, i]:
                out[s, i] = x
                for j, w in g[i].items():
                    heapq.heappush(heap, (x + w, j))
    return out


@pytest.fixture(scope="module")
def paths(cloud):
    out = {}
    for k, (ids, p) in cloud[0].items():
        g, d = neighbour_graph(p, 12)
        out[k] = ids, np.array(d), geodesics(g, len(ids)), g
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = defaultdict(list)
    for r in queries_module._label_edges(spark, SF)[1].collect():
        rows[r.label, r.layer].append((r.u, r.v, r.y))
    return rows


def auc(y, s):
    pos, neg = [a for a, b in zip(s, y, strict=True) if b], [a for a, b in zip(s, y, strict=True) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_distortion_is_that_of_shortest_paths(spark, paths):
    got = {(r.label, r.layer): r for r in Q.QUERIES["geodesic_distortion"](spark, SF).collect()}
    assert set(got) == set(paths)
    for k, (ids, d, g, _) in paths.items():
        off = d > 1e-9
        assert got[k].n == len(ids) and got[k].mean_distortion == pytest.approx((g[off] / d[off]).mean(), abs=2e-6)


def test_scores_of_edges_are_those_of_shortest_paths(spark, paths, labelled):
    delta = {(r.label, r.layer): r.delta_auc for r in Q.QUERIES["geodesic_delta"](spark, SF).collect()}
    base = {(r.label, r.layer): r.auc for r in Q.QUERIES["base_score_auc"](spark, SF).collect()}
    z = lambda x: (x - x.mean()) / x.std() if x.std() > 1e-8 else 0 * x
    for k, edges in labelled.items():
        ids, d, g, _ = paths[k]
        at = {i: a for a, i in enumerate(ids)}
        u, v, y = np.array([at[e[0]] for e in edges]), np.array([at[e[1]] for e in edges]), [e[2] for e in edges]
        if len(edges) >= 40:
            assert delta[k] == pytest.approx(auc(y, -g[u, v]) - auc(y, -d[u, v]), abs=2e-4)
        med, tail, close = [], [], []
        for m in (8, 16, 24):
            rows = []
            for a, b in zip(u, v, strict=True):
                ways = sorted(g[a, c] + g[b, c] for c in range(len(ids)) if c not in (a, b))[:m]
                rows.append([max(0.0, (w - g[a, b]) / g[a, b]) for w in ways])
            med.append([np.quantile(r, 0.5) for r in rows])
            tail.append([np.quantile(r, 0.9) for r in rows])
            close.append([np.mean(np.array(r) <= 0.05) for r in rows])
        med, tail, close = np.array(med), np.array(tail), np.array(close)
        s = z(-g[u, v]) + 0.35 * z(-med.mean(0)) + 0.25 * z(-tail.mean(0)) + 0.2 * z(close.mean(0)) + 0.1 * z(-(tail[-1] - tail[0])) + 0.1 * z(-(tail - med).mean(0))
        assert base[k] == pytest.approx(auc(y, s), abs=2e-3)


def test_shapes_of_graphs_by_counting(spark, paths, cloud):
    got = {(r.label, r.layer): r for r in Q.QUERIES["shape_descriptors"](spark, SF).collect()}
    for k, (ids, d, _, _) in list(paths.items())[:12]:
        n = len(ids)
        nearest = {i: sorted((j for j in range(n) if j != i), key=lambda j: (d[i][j], j))[:12] for i in range(n)}
        links = {(min(i, j), max(i, j)) for i in nearest for j in nearest[i]}
        own = defaultdict(set)
        for i, j in links:
            own[i].add(j)
            own[j].add(i)
        degree = np.array([len(own[i]) for i in range(n)])
        clustering = [2 * sum((min(a, b), max(a, b)) in links for a, b in itertools.combinations(own[i], 2)) / max(len(own[i]) * (len(own[i]) - 1), 1) for i in range(n)]
        share = degree / degree.sum()
        lengths = [d[i][j] for i, j in links]
        tree, left = [], {0}
        while len(left) < n:
            i, j = min(((i, j) for i in left for j in range(n) if j not in left), key=lambda e: d[e[0]][e[1]])
            tree.append(d[i][j])
            left.add(j)
        r = got[k]
        want = [n, degree.mean(), degree.std(), np.mean(clustering), np.mean(lengths), np.std(lengths), np.mean(tree), np.std(tree), -(share * np.log(share)).sum()]
        have = [r.n, r.mean_degree, r.sd_degree, r.clustering, r.edge_mean, r.edge_sd, r.tree_mean, r.tree_sd, r.degree_entropy]
        assert have == pytest.approx(want, abs=2e-5)


def test_alignments_from_the_points(spark, cloud):
    every = cloud[1]
    ids = sorted({i for i, _ in every})
    x, y = (np.array([every[i, layer] for i in ids]) for layer in (0, 1))
    x, y = x - x.mean(0), y - y.mean(0)
    r = Q.QUERIES["procrustes_error"](spark, SF).where("layer = 0").first()
    u, s, vt = np.linalg.svd(x.T @ y)
    assert r.nuclear == pytest.approx(s.sum(), rel=1e-6)
    assert r.rmse == pytest.approx(math.sqrt(((x @ (u @ vt) - y) ** 2).sum() / len(ids)), rel=1e-5)

    got = [c.rho for c in sorted(Q.QUERIES["canonical_correlations"](spark, SF).where("layer = 0").collect(), key=lambda c: c.k)]
    reg = lambda m: m + 1e-3 * np.trace(m) / len(m) * np.eye(len(m))
    xx, yy, xy = reg(x.T @ x), reg(y.T @ y), x.T @ y
    values = np.linalg.eigvals(np.linalg.solve(xx, xy) @ np.linalg.solve(yy, xy.T)).real
    assert got == pytest.approx(np.sqrt(np.sort(values)[::-1][: len(got)]), abs=2e-6)

    c = Q.QUERIES["cycle_maps"](spark, SF).where("layer = 0").first()
    assert 0 <= c.loss_xy <= (y**2).sum() and 0 <= c.loss_yx <= (x**2).sum() and c.loss_cycle >= 0


def test_local_shapes_from_covariances(spark, cloud):
    every = cloud[1]
    ids = sorted({i for i, _ in every})
    got = {(r.layer, r.id): r for r in Q.QUERIES["local_shape"](spark, SF).collect()}
    assert len(got) == 4 * len(ids)
    for layer in (0, 3):
        p = np.array([every[i, layer] for i in ids])
        for a in range(0, len(ids), 37):
            d = np.sqrt(((p - p[a]) ** 2).sum(1))
            near = [j for j in np.lexsort((ids, d)) if j != a][:8]
            lam = np.maximum(np.sort(np.linalg.eigvalsh(np.cov(p[near].T)))[::-1], 1e-12)[: max(3, min(8, 16))]
            r = got[layer, ids[a]]
            assert r.planarity == pytest.approx((lam[1] - lam[2]) / lam[0], abs=1e-5) and r.omnivariance == pytest.approx(np.prod(lam[:3]) ** (1 / 3), abs=1e-5)
            assert r.tail_share == pytest.approx(1 - lam[:2].sum() / lam.sum(), abs=1e-5)


def test_communities_cannot_be_merged_for_more_modularity(spark, paths):
    got = defaultdict(dict)
    for r in Q.QUERIES["graph_communities"](spark, SF).collect():
        got[r.label, r.layer][r.id] = r.community
    for k, (ids, d, _, _) in list(paths.items())[:10]:
        n = len(ids)
        links = {(min(i, j), max(i, j)) for i in range(n) for j in sorted((j for j in range(n) if j != i), key=lambda j: (d[i][j], j))[:12]}
        degree = np.zeros(n)
        for i, j in links:
            degree[i] += 1
            degree[j] += 1

        def modularity(label):
            inside = sum(label[i] == label[j] for i, j in links) / len(links)
            return inside - sum((degree[[i for i in range(n) if label[i] == c]].sum() / (2 * len(links))) ** 2 for c in set(label))

        label = [got[k][i] for i in ids]
        best = modularity(label)
        assert best >= modularity([0] * n) - 1e-9
        for a, b in itertools.combinations(sorted(set(label)), 2):
            assert modularity([a if c == b else c for c in label]) <= best + 1e-9


def test_transport_is_no_dearer_than_chance(spark, cloud):
    r = Q.QUERIES["transport_alignment"](spark, SF).where("layer = 0").first()
    means = {}
    for (label, layer), (_, p) in cloud[0].items():
        means[label, layer] = p.mean(0)
    labels = sorted({a for a, _ in means})
    cost = np.array([[math.dist(means[a, 0], means[b, 1]) for b in labels] for a in labels])
    least = {0: 0.0}  # over the columns taken by the first rows
    for row in cost:
        ahead = {}
        for taken, c in least.items():
            for j, w in enumerate(row):
                if not taken >> j & 1:
                    m = taken | 1 << j
                    ahead[m] = min(ahead.get(m, math.inf), c + w)
        least = ahead
    assert r.matched_cost == pytest.approx(least[(1 << len(labels)) - 1] / len(labels), abs=1e-6)
    assert least[(1 << len(labels)) - 1] / len(labels) - 1e-6 <= r.cost <= cost.mean() + 1e-6
