"""First homology of patches: no task has a slice, and each total is that of the patch by itself."""

import numpy as np
import pytest

from orrery.operators import geometry, vectors
from orrery.operators import kernels as K


def test_no_task_has_a_slice(spark, monkeypatch):
    monkeypatch.setattr(geometry, "per_slice", None)
    rng = np.random.default_rng(3)
    p = rng.normal(size=(40, 3))
    p[7] = p[8]
    rows = [(s, i, p[i].tolist()) for s in (0, 1) for i in range(40)] + [(2, 0, [0.0, 0.0, 0.0])]
    got = geometry.local_persistence(spark.createDataFrame(rows, "s int, vec_id long, vec array<double>"), ["s"], 8).collect()
    d = vectors._square(p, p, "euclidean")
    near = K.nearest(d, 8)
    want = {}
    for i in range(40):
        at = np.append(i, near[i])
        bars = K.rips_h1(d[np.ix_(at, at)])
        want[i] = (bars[:, 1] - bars[:, 0]).sum()
    assert len(got) == 81 and any(want.values())
    assert all(r.total == pytest.approx(want[r.id] if r.s < 2 else 0.0, abs=1e-12) for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 12, 20])
def test_bits_and_sets_find_the_same_pairs(n, monkeypatch):
    rng = np.random.default_rng(n)
    for p in (rng.normal(size=(n, 3)), rng.integers(0, 3, size=(n, 2)).astype(float)):
        d = vectors._square(p, p, "euclidean")
        bits = K.rips_h1(d)
        monkeypatch.setattr(K, "BITS", 0)
        assert np.array_equal(bits, K.rips_h1(d))
        monkeypatch.undo()
