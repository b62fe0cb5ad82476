"""A stream read file by file ends at the rows of the batch form."""

from pyspark.sql import functions as F

from orrery.operators.sequences import transitions
from orrery.sources.tables import event_tokens
from orrery.streaming import events as E

SF = "/root/testdata/sf0.001"


def source(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    rows = e.collect()
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, e.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return E.read_events(spark, str(tmp_path / "in"), 1), e


def test_windowed_rates(spark, tmp_path):
    stream, table = source(spark, tmp_path)
    q = E.append(E.windowed_rates(stream, "1 day", "400 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    want = {(r.start, r.event_type): r.n for r in E.windowed_rates(table, "1 day").collect()}
    got = {(r.start, r.event_type): r.n for r in spark.read.schema("start timestamp, event_type string, n long, mean_value double").parquet(str(tmp_path / "out")).collect()}
    assert set(got.items()) <= set(want.items())


def test_transition_counts(spark, tmp_path):
    stream, _ = source(spark, tmp_path)
    q = E.transition_counts(stream).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.sql("SELECT user_id, h1, token, max(n) FROM counts GROUP BY ALL").collect()}
    steps = transitions(event_tokens(spark, SF)).groupBy("user_id", "h1", "token").agg(F.count(F.lit(1)))
    assert got == {tuple(r) for r in steps.collect()}


def test_sessions_cover_all_events(spark):
    table = spark.read.parquet(f"{SF}/events.parquet")
    assert E.sessions(table).agg(F.sum("n")).first()[0] == table.count()
