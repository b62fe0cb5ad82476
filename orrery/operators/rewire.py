"""Degree-keeping rewiring of large graphs in rounds without conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


def _hash(*parts: Column | str, salt: str) -> Column:
    return F.xxhash64(*[F.col(p) if isinstance(p, str) else p for p in parts], F.lit(salt))


def _edge(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def rewired(edges: DataFrame, keys: Sequence[str] = (), rounds: int = 12, salt: str = "rewire", strata: DataFrame | None = None) -> DataFrame:
    """(keys, u, v), u < v: each slice's edges after many double-edge swaps that keep every degree. With strata
    (keys, u, v, stratum) of pairs, unlisted ones being of none, a swap also keeps how many edges each stratum has.

    A round deals a slice's edges to half as many places by hash, and two edges of a place exchange an end. A
    proposal goes if it makes a loop or an edge that is there, or if another of the round with a smaller hash
    makes the same edge; the rest are done at once. Every number comes from a hash of keys, edge and round: the
    same in each run, and another one for another value of a key."""
    keys = list(keys)
    by = [*keys, "u", "v"]
    state = edges.where("u <> v").select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    state = graph.written(state, "rewired")
    size = graph.written(state.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / 2), F.lit(1)).alias("places")), "rewired-sizes")
    of = None if strata is None else graph.written(strata.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "stratum"), "rewired-strata")
    for r in range(rounds):
        dealt = (state.join(size, keys) if keys else state.crossJoin(F.broadcast(size))).withColumn("place", F.pmod(_hash(*by, salt=f"{salt}:{r}:place"), F.col("places")))  # a row a slice
        two = F.slice(F.sort_array(F.collect_list(F.struct(_hash(*by, salt=f"{salt}:{r}:order").alias("h"), "u", "v"))), 1, 2)
        pairs = dealt.groupBy(*keys, "place").agg(two.alias("e")).where(F.size("e") == 2)
        a, b, c, d = F.col("e")[0]["u"], F.col("e")[0]["v"], F.col("e")[1]["u"], F.col("e")[1]["v"]
        h = _hash(*keys, F.col("e")[0]["h"], F.col("e")[1]["h"], salt=f"{salt}:{r}:swap")
        coin = F.pmod(h, F.lit(2)) == 0
        made = pairs.where((a != c) & (a != d) & (b != c) & (b != d)).select(
            *keys, h.alias("h"), F.struct(a.alias("u"), b.alias("v")).alias("old1"), F.struct(c.alias("u"), d.alias("v")).alias("old2"),
            F.when(coin, _edge(a, d)).otherwise(_edge(a, c)).alias("new1"), F.when(coin, _edge(c, b)).otherwise(_edge(b, d)).alias("new2"),
        )
        made = graph.written(made, "rewired-proposals")
        each = lambda names: made.select(*keys, "h", F.explode(F.array(*names)).alias("x")).select(*keys, "h", "x.u", "x.v")  # noqa: E731, B023
        new = each(["new1", "new2"])
        there = new.join(state, by, "left_semi").select(*keys, "h")
        first = new.groupBy(*by).agg(F.min("h").alias("first"))
        late = new.join(first, by).where("h <> first").select(*keys, "h")
        refused = there.unionByName(late)
        if of is not None:
            kinds = made.select(*keys, "h", F.posexplode(F.array("old1", "old2", "new1", "new2")).alias("i", "x")).select(*keys, "h", "i", "x.u", "x.v").join(of, by, "left")
            bag = lambda new_: F.sort_array(F.collect_list(F.when((F.col("i") >= 2) == F.lit(new_), F.struct(F.col("stratum").isNull().alias("none"), "stratum"))))
            unlike = kinds.groupBy(*keys, "h").agg(bag(False).alias("was"), bag(True).alias("now")).where("was <> now").select(*keys, "h")
            refused = refused.unionByName(unlike)
        kept = graph.written(made.join(refused.distinct(), [*keys, "h"], "left_anti"), "rewired-kept")
        gone = kept.select(*keys, F.explode(F.array("old1", "old2")).alias("x")).select(*keys, "x.u", "x.v")
        come = kept.select(*keys, F.explode(F.array("new1", "new2")).alias("x")).select(*keys, "x.u", "x.v")
        state = graph.written(state.join(gone, by, "left_anti").unionByName(come), "rewired")
    return state
