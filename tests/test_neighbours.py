"""Nearest neighbours of a block against a panel: right with ties, copies and odd values, and few pairs measured."""

import numpy as np
import pytest

from orrery.operators import vectors as V


def brute(ids, m, k, metric):
    d = V._square(m, m, metric)
    if metric == "cosine":
        u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        d = 1 - sum(u[:, None, i] * u[None, :, i] for i in range(m.shape[1]))
    d[ids[:, None] == ids[None, :]] = np.inf
    out = {}
    for i, row in zip(ids, d, strict=True):
        order = [j for j in np.lexsort((ids, row)) if np.isfinite(row[j])][:k]
        out[int(i)] = [(int(ids[j]), row[j]) for j in order]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_a_block_against_a_panel_is_brute_force(metric, monkeypatch):
    monkeypatch.setattr(V, "TILE", (64, 50))
    rng = np.random.default_rng(5)
    m = np.round(rng.standard_normal((420, 3)), 1)  # many ties
    m[50:140] = m[50]  # one point very often
    m[7], m[8], m[9] = 0.0, np.nan, np.inf
    ids = rng.permutation(420)
    u, v, far = V._nearest(ids, m, ids, m, 4, metric)
    got: dict[int, list] = {}
    for a, b, x in zip(u.tolist(), v.tolist(), far.tolist(), strict=True):
        got.setdefault(a, []).append((b, x))
    with np.errstate(all="ignore"):
        want = {a: r for a, r in brute(ids, m, 4, metric).items() if r}
    assert got == want


def test_few_pairs_are_measured(monkeypatch):
    seen = []
    merge = V._merge
    monkeypatch.setattr(V, "_merge", lambda best, which, r, *rest: (seen.append(len(r)), merge(best, which, r, *rest))[1])
    rng = np.random.default_rng(6)
    m, ids = 1e3 + rng.standard_normal((20000, 8)), np.arange(20000)
    V._nearest(ids[:1000], m[:1000], ids, m, 8, "euclidean")
    assert sum(seen) < 0.005 * 1000 * 20000


def test_an_edge_is_as_long_as_its_neighbours_distance():
    m = np.random.default_rng(7).standard_normal((300, 16))
    assert (V.apart(m[:-1], m[1:]) == np.diagonal(V._square(m[:-1], m[1:], "euclidean"))).all()


@pytest.mark.parametrize("scale", [1e-200, 1e-30, 1.0, 1e30])
def test_single_precision_only_screens(scale, monkeypatch):
    """Products are in single precision, distances and their order are not, whatever the numbers' size."""
    made = []
    few = V._few_true
    monkeypatch.setattr(V, "_few_true", lambda mask: (made.append(mask.size), few(mask))[1])
    rng = np.random.default_rng(8)
    m = rng.standard_normal((300, 5))
    m[100:200] = m[:100] * (1 + 1e-9)  # nearer than single precision tells
    m[250:] = m[250] + 1e-12 * rng.standard_normal((50, 5))
    m, ids = m * scale, np.arange(300)
    u, v, far = V._nearest(ids, m, ids, m, 3, "euclidean")
    want = brute(ids, m, 3, "euclidean")
    assert made and [(b, x) for i in range(300) for b, x in want[i]] == list(zip(v[np.argsort(u, kind="stable")].tolist(), far[np.argsort(u, kind="stable")].tolist(), strict=True))


def test_heavy_tasks_are_not_put_together(spark):
    """Blocks are few bytes and much work; a slice's points don't go through one task on their way."""
    points = spark.createDataFrame([(s, i, [float(i % 17), float(s)]) for s in range(3) for i in range(60)], "s int, vec_id long, vec array<double>")
    plan = V.knn(points, 2, ["s"], block=10)._jdf.queryExecution().executedPlan().toString()
    assert f", {8 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
