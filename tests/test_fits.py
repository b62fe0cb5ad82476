"""Models fitted together against one slice at a time."""

import numpy as np
import pandas as pd

from orrery.operators import fits, models
from orrery.operators import kernels as K

NAMES = ["a", "b", "c"]


def table(spark, slices, n=90, seed=5):
    rng, rows = np.random.default_rng(seed), []
    for s in range(slices):
        x = rng.standard_normal((n, 3)) * [1, 10, 0.1] + [0, 100, 5]
        y = (x[:, 0] * (s % 3) + 0.1 * (x[:, 1] - 100) + rng.standard_normal(n) > 0).astype(int)
        if s == 1:
            y = (x[:, 0] > 0).astype(int)  # told apart without an error
        if s == 2:
            x[:, 2] = 7.0  # a column that says nothing
        if s == 3:
            y[:] = 1
        if s == 4:
            y[:] = 0
            y[:2] = 1
        fold = np.arange(n) % 3 if s != 5 else np.arange(n) % 2
        if s == 6:
            x[::7, 1] = np.nan
        rows += [(s // 2, s % 2, i, int(y[i]), int(fold[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "g int, h int, i int, y int, fold int, a double, b double, c double")


def aucs(df):
    return df.toPandas().sort_values(["g", "h"]).reset_index(drop=True)


def test_fits_of_many_keys_equal_the_fit_of_each(spark, monkeypatch):
    monkeypatch.setattr(fits, "PART", 40)  # a key's rows lie in three tasks
    monkeypatch.setattr(fits, "TASK_KEYS", 4)
    df = table(spark, 8)
    rows = df.toPandas()
    _, m = fits.fit(df, NAMES, "y", ["g", "h"], "fold", 3, l1=0.01, l2=1e-3)
    seen = 0
    for r in m.collect():
        own = rows[(rows.g == r.g) & (rows.h == r.h)]
        x, y, fold = np.nan_to_num(own[NAMES].to_numpy()), own.y.to_numpy(), own.fold.to_numpy()
        for f in sorted(set(fold)):
            if 0 < y[fold != f].sum() < (fold != f).sum():
                want = K.logistic(x[fold != f], y[fold != f].astype(float), 0.01, 1e-3, rounds=20_000)
                assert np.allclose(r.weights[f], want, rtol=1e-5, atol=1e-6 * max(1, np.abs(want).max())), (r.g, r.h, f)
                seen += 1
            else:
                assert r.weights[f] is None
    assert seen > 18


def test_cross_validated_auc_equals_the_kernel(spark):
    df = table(spark, 8)
    got, want = aucs(fits.cross_validated(df, NAMES, "y", ["g", "h"], "a", 0.01)), aucs(models.cv_logistic(df, NAMES, "y", ["g", "h"], "a", 0.01))
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, atol=1e-3, rtol=0)
    assert got.auc_model.isna().sum() == want.auc_model.isna().sum() >= 1


def test_wild_steps_come_back(spark):
    """Strong effects and rare positives, where a plain Newton step goes uphill."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 3)) ** 3
    y = (x[:, 0] + 0.1 * x[:, 1] > 4).astype(int)
    df = spark.createDataFrame([(1, int(a), *map(float, b)) for a, b in zip(y, x)], "g int, y int, a double, b double, c double")
    for l1, l2 in ((0.0, 1e-4), (0.05, 0.0)):
        got = fits.fit(df, NAMES, "y", ["g"], l1=l1, l2=l2)[1].first().weights[0]
        want = K.logistic(x, y.astype(float), l1, l2, rounds=100_000)
        assert np.allclose(got, want, rtol=1e-3, atol=1e-4)


def test_nothing_to_fit(spark):
    df = table(spark, 1).limit(0)
    assert fits.cross_validated(df, NAMES, "y", ["g", "h"], "a").count() == 0
