"""Every query with an equivalent in SQL gives the same rows in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from orrery import registry as Q
from orrery.sources.tables import TABLES

Q.load()

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind == "f":
            df[k] = df[k].astype(float).round(5) + 0.0
    return sorted(str(tuple(None if not isinstance(x, (list, tuple)) and pd.isna(x) else float(x) if isinstance(x, (int, float)) else x for x in r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(n for n in set(Q.QUERIES) - set(Q.SQL) if not n.startswith("screen_") and n != "cv_logit_delta"))
def test_query_without_sql_runs_and_repeats(spark, name):
    a, b = (sorted(map(str, Q.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a and a == b


@pytest.mark.parametrize("name", ["screen_transfer", "cv_logit_delta"])
def test_screen(spark, name):
    rows = Q.QUERIES[name](spark, SF).collect()
    assert rows and all(r.auc_model is None or 0 <= r.auc_model <= 1 for r in rows)


def test_every_hypothesis_has_features_and_a_mechanism():
    from orrery.plans import nulls, screens

    assert len(screens.SCREENS) == 143 and {s.family for s in screens.SCREENS.values()} <= set(screens.FEATURES)
    assert sum(k in nulls.MECHANISM for s in screens.SCREENS.values() for k in s.null_kinds) > 200


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(Q.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
