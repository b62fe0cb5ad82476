"""Replicates never go through the driver, and a permutation is the one that MD5 gives."""

import hashlib

import pytest
from pyspark.sql import functions as F

from orrery.functions import random as R
from orrery.operators import fits


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicates_of_a_small_table_are_not_broadcast(spark):
    many = R.replicates(spark.range(50).withColumnRenamed("id", "node"), 24)
    edges = spark.range(1000).select((F.col("id") % 50).alias("node"), (F.col("id") % 24).cast("int").alias("perm_idx"))
    assert "Broadcast" not in plan(edges.join(many, ["node", "perm_idx"]))


def test_a_permutation_deals_rows_out_once(spark):
    rows = R.replicates(spark.range(50).select("id", (F.col("id") % 3).alias("bin"), F.col("id").alias("v")), 24)
    seen = plan(R.permuted(rows, ["v"], "id", "salt", ["bin"], "perm_idx"))
    assert "Join" not in seen and seen.count("Exchange hashpartitioning") == 1


def test_a_permutation_is_the_one_of_the_hashes(spark):
    data = [(i, i % 3 if i < 28 else None, None if i == 5 else i * 10, f"s{i}") for i in range(30)]
    df = R.replicates(spark.createDataFrame(data, "id long, bin long, v long, w string"), 3)
    got = R.permuted(df, ["v", "w"], "id", "salt", ["bin"], "perm_idx")
    assert set(got.columns) == {"id", "bin", "v", "w", "perm_idx", "v_perm", "w_perm"}
    want = set()
    for p in range(3):
        for b in range(3):
            own = [x for x in data if x[1] == b]
            moved = sorted(own, key=lambda x: (hashlib.md5(f"{x[0]}|{p}|salt".encode()).hexdigest(), x[0]))  # noqa: B023
            want |= {(*x, p, m[2], m[3]) for x, m in zip(own, moved, strict=True)}
    rows = got.select("id", "bin", "v", "w", "perm_idx", "v_perm", "w_perm").collect()
    assert len(rows) == len(want) and set(map(tuple, rows)) == want


def test_models_are_the_same_in_any_number_of_tasks(spark, monkeypatch):
    rows = spark.range(600).select((F.col("id") % 6).alias("k"), (F.col("id") % 5 % 2).alias("y"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("z"), (F.floor(F.col("id") / 7) % 3).cast("int").alias("fold"))
    get = lambda: {r.k: r.auc_model for r in fits.cross_validated(rows, ["x", "z"], "y", ["k"], "x", 0.01).collect()}
    one = get()
    monkeypatch.setattr(fits, "TASK_KEYS", 1)
    assert len(one) == 6 and get() == pytest.approx(one, abs=1e-9)


def test_rows_of_several_tables_are_written_once(spark, monkeypatch):
    labels, write = [], fits.written
    monkeypatch.setattr(fits, "written", lambda df, label: labels.append(label) or write(df, label))
    rows = spark.range(900).select((F.col("id") % 6).alias("k"), (F.col("id") % 5 % 2).alias("y"), F.sin("id").alias("x"), F.cos(F.col("id") * 3).alias("z"), (F.floor(F.col("id") / 7) % 3).cast("int").alias("fold"))
    get = lambda df: {r.k: (r.n, r.auc_base, r.auc_model) for r in fits.cross_validated(df, ["x", "z"], "y", ["k"], "x", 0.01).collect()}
    want = get(rows)
    assert labels.count("fit-rows") == 1 and "fit-raw" not in labels
    labels.clear()
    got = get([rows.where("k < 2"), rows.where("k >= 2")])
    assert labels.count("fit-rows") == 2 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import os
    import time

    from orrery.operators import graph

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    held = lambda: set(glob.glob(os.path.join(root, "*", "shuffle_*.data")))
    before = held()
    graph.written(spark.range(200_000).withColumn("x", F.rand(1)).repartition(4, "x"), "tidy")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.2)
    assert not held() - before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
