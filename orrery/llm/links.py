"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import HOT, work_folder


def _moved(both: DataFrame, least: DataFrame, hot: bool) -> DataFrame:
    """both with the m of its a. Where there are links enough for it (hot), nodes of more than HOT neighbours, of which there are fewer than
    links / HOT, are broadcast, so that a hub's links stay where they are; the others are joined by
    shuffle, at most HOT links a node."""
    if not hot:
        return both.join(least.drop("n"), "a")
    hubs = F.broadcast(least.where(F.col("n") > HOT).select("a", "m"))
    rest = least.where(F.col("n") <= HOT).select("a", "m")
    return both.join(hubs, "a").unionByName(both.join(rest, "a"))


def _star(edges: DataFrame, small: bool, hot: bool) -> DataFrame:
    """One round. Large: each larger neighbour of a node moves to the least of the neighbourhood.
    Small: each smaller neighbour, and the node itself, does."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    if not small:
        least = least.withColumn("m", F.least("a", "m"))
        moved = _moved(both.where("b > a"), least, hot).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = _moved(both, least, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) of orderable ids the table (node, root) of every linked node; the root is
    the least node of the component. Each round is checkpointed to the shared folder. Loops and
    repeats are ignored, null ends dropped; no links give an empty table."""
    work_folder(edges.sparkSession)
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = edges.count(), None
    while True:
        hot = 2 * seen[0] > HOT  # else no node can have so many links in this round
        edges = _star(_star(edges, small=False, hot=hot), small=True, hot=hot).checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
