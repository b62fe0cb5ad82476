"""The jobs: equal to their SQL, alike when run again, and, the incremental one, over input that grows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import layer_campaign, queries, text_screen
from jobs._job import config
from orrery.sources.tables import TABLES
from tests.test_oracles import rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    was = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert rows(got) == rows(want)
    now = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    assert {k: v for k, v in now.items() if was.get(k) != v} == {}


def held(df):
    return sorted(map(str, df.collect()))


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_text_screen_takes_only_new_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    source, marks, out, mark = (str(tmp_path / x) for x in ("documents", "labels", "out", "mark"))
    job = lambda o=out, m=mark: text_screen.run(spark, source, marks, o, m, {"replicates": 4, "files_per_batch": 1})

    docs.where("doc_id % 3 = 0").repartition(2).write.mode("append").parquet(source)
    labels.where("doc_id % 5 > 0").write.parquet(marks)
    first = held(job())
    taken = files(tmp_path / "out" / "measures")
    assert sum(1 for _ in taken) > 0 and spark.read.parquet(f"{out}/measures").count() == docs.where("doc_id % 3 = 0").count()

    assert held(job()) == first  # nothing new
    assert files(tmp_path / "out" / "measures") == taken

    docs.where("doc_id % 3 > 0").repartition(2).write.mode("append").parquet(source)
    labels.where("doc_id % 5 = 0").write.mode("append").parquet(marks)  # labels may come late
    grown = held(job())
    later = files(tmp_path / "out" / "measures")
    assert {p: t for p, t in later.items() if p in taken} == taken and len(later) > len(taken)
    assert spark.read.parquet(f"{out}/measures").count() == docs.count()
    assert grown != first and grown == held(job(str(tmp_path / "once"), str(tmp_path / "once-mark")))


def test_text_screen_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels"))
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents"))
    assert text_screen.run(spark, *(str(tmp_path / x) for x in ("documents", "labels", "out", "mark"))).count() == 0


def test_campaign_replaces_the_partitions_it_makes(spark, tmp_path):
    out = str(tmp_path / "out")
    some = {"replicates": 3, "layers": 2}
    whole = held(layer_campaign.run(spark, f"{SF}/embeddings.parquet", out, some))
    others = files(tmp_path / "out" / "results" / "domain=0")
    again = layer_campaign.run(spark, f"{SF}/embeddings.parquet", out, some | {"domains": [1]})
    assert held(again) == whole
    assert files(tmp_path / "out" / "results" / "domain=0") == others
    assert {r.split for r in spark.read.parquet(f"{out}/summary").collect()} == {"source_disjoint", "target_disjoint", "dual_axis"}


def test_unknown_settings_are_refused():
    with pytest.raises(ValueError, match="replicate"):
        config("text_screen", {"replicate": 3})
