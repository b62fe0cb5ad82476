"""The event operators over a stream: windowed counts with late data, transition counts by key, and result
rows appended as they come. The batch forms are in operators.sequences."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of events as they appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, mean_value): a row per window once the watermark has passed it; events later
    than `late` are left out. Works on a stream and on a table."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def transition_counts(events: DataFrame) -> DataFrame:
    """(user_id, h1, token, n) after each batch: counts of a user's successive event types so far. The state is
    the last type and one count per pair of types, whatever the stream's length; a batch's events are taken in
    order of time and id."""

    def update(key, frames: Iterator, state):
        import pandas as pd

        last, counts = state.get if state.exists else (None, "")
        known = {tuple(k.split(">")): int(v) for k, v in (x.rsplit("=", 1) for x in counts.split(";") if x)}
        changed = {}
        for t in pd.concat(list(frames)).sort_values(["ts", "event_id"]).event_type:
            if last is not None:
                known[last, t] = changed[last, t] = known.get((last, t), 0) + 1
            last = t
        state.update((last, ";".join(f"{a}>{b}={n}" for (a, b), n in sorted(known.items()))))
        yield pd.DataFrame([(key[0], a, b, n) for (a, b), n in sorted(changed.items())], columns=["user_id", "h1", "token", "n"])

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, h1 string, token string, n long", "last string, counts string", "update", "NoTimeout")


def append(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Start a query that appends df to parquet files, exactly once by its checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
