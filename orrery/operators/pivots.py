"""Exact nearest neighbours through a pivot index.

A hashed share of a slice's points are pivots; every point lies in the block of its nearest pivot, and a block
has the radius of its farthest point. A point's own block bounds how far its k-th neighbour can be; then only
blocks whose nearest possible point, by the triangle inequality, is within the bound are looked at. How many
that are is the data's matter: few where points lie in clumps or along surfaces, nearly all where they fill a
space of many dimensions evenly, which costs what comparing everything costs. Blocks that many points
choose are dealt out in parts, and so are a block's queries, so that a task holds a bounded number of each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import written
from .vectors import _matrix, _square


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _keyed(keys: Sequence[str], key, schema: pa.Schema, n: int) -> dict:
    return {c: pa.array([v.as_py()] * n, schema.field(c).type) for c, v in zip(keys, key, strict=False)}


def _unit(m: np.ndarray, metric: str) -> np.ndarray:
    """What the triangle inequality holds for: unit vectors, whose distances order as their cosines do."""
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if metric == "cosine" else m


def _found(keys: Sequence[str], key, schema: pa.Schema, qi: np.ndarray, q: np.ndarray, di: np.ndarray, d: np.ndarray, k: int, metric: str) -> pa.Table:
    dist = _square(q, d, metric)
    dist[qi[:, None] == di[None, :]] = np.inf
    order = np.lexsort((np.broadcast_to(di, dist.shape), dist), axis=1)[:, :k]
    row, col = np.repeat(np.arange(len(qi)), order.shape[1]), order.ravel()
    ok = np.isfinite(dist[row, col])
    row, col = row[ok], col[ok]
    return pa.table(_keyed(keys, key, schema, len(row)) | {"id": pa.array(qi[row], schema.field("id").type), "neighbour": pa.array(di[col], schema.field("id").type), "distance": dist[row, col]})


def assigned(points: DataFrame, keys: Sequence[str], id_col: str, metric: str, block: int) -> tuple[DataFrame, DataFrame]:
    """rows (keys, id, vec, chunk, home, away) and pivots (keys, home, pvec, chunks): home is the id of the nearest pivot,
    away how far it is."""
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("chunks"))
    named = points.select(*keys, F.col(id_col).alias("id"), "vec")
    rows = (named.join(size, keys) if keys else named.crossJoin(F.broadcast(size))).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))  # a row a slice
    rows = written(rows, "pivot-rows")
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(block)) == 0).select(*keys, F.col("id").alias("home"), F.col("vec").alias("pvec"), "chunks")
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("id", F.lit(7)).alias("h"), "id", "vec", "chunks")).alias("x")).select(*keys, F.col("x.id").alias("home"), F.col("x.vec").alias("pvec"), "x.chunks")
    pivots = written(drawn.unionByName(first).dropDuplicates([*keys, "home"]), "pivots")

    def run(key, left, right):
        order = np.argsort(right["home"].to_numpy(), kind="stable")
        names, p = right["home"].to_numpy()[order], _unit(_matrix(right, "pvec"), metric)[order]
        dist = _square(_unit(_matrix(left), metric), p, "euclidean")
        at = dist.argmin(1) if left.num_rows else np.zeros(0, int)
        return left.select([*keys, "id", "vec", "chunk"]).append_column("home", pa.array(names[at], left.schema.field("id").type)).append_column("away", pa.array(dist[np.arange(len(at)), at]))

    spread = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    schema = ", ".join([*(f"{c} {_kind(points, c)}" for c in keys), f"id {_kind(points, id_col)}", "vec array<double>", "chunk long", f"home {_kind(points, id_col)}", "away double"])
    by = [*keys, "chunk"]
    out = rows.select(*keys, "id", F.col("vec").cast("array<double>").alias("vec"), "chunk").groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(run, schema)
    return written(out, "pivot-homes"), pivots


def candidates(rows: DataFrame, pivots: DataFrame, k: int, keys: Sequence[str], metric: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows with the part of their block; the neighbours found in own parts; and (keys, id, home, part) of the other parts that
    may hold a nearer one."""
    keys = list(keys)
    blocks = written(rows.groupBy(*keys, "home").agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / (2 * block)).cast("long").alias("parts")), "pivot-blocks")
    rows = rows.join(blocks.select(*keys, "home", "parts"), [*keys, "home"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))).drop("parts")
    rows = written(rows, "pivot-parts")
    found_kind = ", ".join([*(f"{c} {_kind(rows, c)}" for c in keys), f"id {_kind(rows, 'id')}", f"neighbour {_kind(rows, 'id')}", "distance double"])

    def own(key, table):
        ids, m = table["id"].to_numpy(), _matrix(table)
        return _found(keys, key, table.schema, ids, m, ids, m, k, metric)

    first = written(rows.groupBy(*keys, "home", "part").applyInArrow(own, found_kind), "pivot-own")
    kth = F.max("distance") if metric != "cosine" else F.sqrt(2 * F.max("distance"))
    bounds = first.groupBy(*keys, "id").agg(F.when(F.count(F.lit(1)) >= k, kth).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = rows.join(bounds, [*keys, "id"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def near(key, left, right):
        if not left.num_rows:
            left = left.slice(0, 0)
        p, radius = _unit(_matrix(right, "pvec"), metric), right["radius"].to_numpy()
        dist = _square(_unit(_matrix(left), metric), p, "euclidean")
        hit, block_at = np.nonzero(dist - radius[None, :] <= left["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9)
        parts = right["parts"].to_numpy()[block_at]
        again = np.repeat(np.arange(len(hit)), parts)
        part = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        hit, block_at = hit[again], block_at[again]
        mine = (left["home"].to_numpy()[hit] == right["home"].to_numpy()[block_at]) & (left["part"].to_numpy()[hit] == part)
        hit, block_at, part = hit[~mine], block_at[~mine], part[~mine]
        ids = left.schema.field("id").type
        return pa.table(_keyed(keys, key, left.schema, len(hit)) | {"id": pa.array(left["id"].to_numpy()[hit], ids), "home": pa.array(right["home"].to_numpy()[block_at], ids), "part": pa.array(part, pa.int64())})

    chunks = pivots.join(blocks, [*keys, "home"]).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    by = [*keys, "chunk"]
    kind = ", ".join([*(f"{c} {_kind(rows, c)}" for c in keys), f"id {_kind(rows, 'id')}", f"home {_kind(rows, 'id')}", "part long"])
    return rows, first, written(bounded.groupBy(*by).cogroup(chunks.groupBy(*by)).applyInArrow(near, kind), "pivot-candidates")


def knn(points: DataFrame, k: int, keys: Sequence[str] = (), id_col: str = "vec_id", metric: str = "euclidean", block: int = 1024) -> DataFrame:
    """(keys, id, neighbour, distance, rank): the k nearest others, ties by id, as vectors.knn gives them. metric: euclidean or
    cosine."""
    keys = list(keys)
    rows, pivots = assigned(points, keys, id_col, metric, block)
    rows, first, more = candidates(rows, pivots, k, keys, metric, block)
    at = [*keys, "home", "part"]
    asked = written(more.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("shares")), "pivot-asked")
    deal = lambda df: df.join(asked, at)
    queries = deal(more.join(rows.select(*keys, "id", "vec"), [*keys, "id"])).withColumn("share", F.pmod(F.xxhash64("id", F.lit(5)), F.col("shares")))
    data = deal(rows.select(*at, F.col("id").alias("id"), F.col("vec").alias("vec"))).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    by = [*at, "share"]

    def meet(key, left, right):
        return _found(keys, key, left.schema, left["id"].to_numpy(), _matrix(left), right["id"].to_numpy(), _matrix(right), k, metric)

    kind = ", ".join([*(f"{c} {_kind(rows, c)}" for c in keys), f"id {_kind(rows, 'id')}", f"neighbour {_kind(rows, 'id')}", "distance double"])
    second = queries.select(*by, "id", "vec").groupBy(*by).cogroup(data.select(*by, "id", "vec").groupBy(*by)).applyInArrow(meet, kind)
    w = Window.partitionBy(*keys, "id").orderBy("distance", "neighbour")
    return first.unionByName(second).repartition(*keys, "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
