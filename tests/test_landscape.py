"""Quantiles of all pairs' distances, counted pass by pass, against the pairs themselves."""

import numpy as np
import pytest

from orrery.operators import descriptors as D
from orrery.operators import vectors


@pytest.mark.parametrize("block", [8192, 16])
def test_quantiles_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "pairs", None)  # no pair is a row
    monkeypatch.setattr(vectors, "PAIRED", block)
    rng = np.random.default_rng(5)
    p = rng.normal(size=(60, 4))
    p[20:40] = p[20]  # a third of all are equal
    p[50:] = rng.integers(0, 3, size=(10, 4))
    rows = [(1, i, p[i].tolist()) for i in range(60)] + [(2, i, p[i].tolist()) for i in range(18, 23)] + [(3, 0, p[0].tolist()), (3, 1, p[1].tolist()), (4, 2, p[2].tolist())]
    points = spark.createDataFrame(rows, "layer int, vec_id long, vec array<double>")
    modules = spark.createDataFrame([("a", i) for i in range(60)] + [("b", 0), ("b", 1), ("b", 2), ("b", 2)], "module string, node long")
    got = {(r.module, r.layer): r for r in D.module_landscape(points, modules, ["layer"]).collect()}
    assert len(got) == 7
    for layer, at in ((1, range(60)), (2, range(18, 23))):
        x = p[list(at)]
        d = vectors._square(x, x, "euclidean")[np.triu_indices(len(x), 1)]
        r = got["a", layer]
        assert r.n == len(x) and [r[c] for c in D.LANDSCAPE] == pytest.approx([*np.quantile(d, (0.1, 0.25, 0.5, 0.75, 0.9)), d.mean(), d.std()], abs=1e-12)
    assert [got["a", 3][c] for c in ("n", "q50")] == [2, 0.0]
    # a row that is there twice meets others twice and not itself
    x = p[[0, 1, 2, 2]]
    d = vectors._square(x, x, "euclidean")[np.triu_indices(4, 1)][:5]
    points = spark.createDataFrame([(1, i, p[i].tolist()) for i in range(3)], "layer int, vec_id long, vec array<double>")
    r = D.module_landscape(points, modules.where("module = 'b'"), ["layer"]).first()
    assert r.n == 4 and r.q50 == pytest.approx(np.median(d)) and r.sd == pytest.approx(d.std())
