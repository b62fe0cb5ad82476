"""Point clouds as (keys..., id, vec array<double>): neighbours, projections, dimension estimates.

Neighbours are found block against panel: the points of a slice are dealt to blocks as queries and to larger
panels as data, each pair is one task's work in numpy, and the k best of each point are merged by a window. No
task holds more than a block and a panel, whatever the slice's size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions.stats import zscore
from .graph import heavy, written

#: Queries of a task; data of a task, in blocks; rows and columns of a matrix product.
BLOCK, PANEL, TILE = 16384, 4, (512, 4096)


def _matrix(table: pa.Table, column: str = "vec") -> np.ndarray:
    flat = table.column(column).combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    n = len(flat)
    return np.asarray(flat.flatten(), np.float64).reshape(n, -1) if n else np.empty((0, 0))


def _square(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of a to all rows of b, summed in order of the dimensions."""
    if metric == "cosine":
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
        return 1 - a @ b.T
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        out += gap * gap
    return np.sqrt(out)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b, summed in order of the dimensions: to the bit as neighbours' are."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += (x - y) ** 2
    return np.sqrt(out)


def _nearest(qi: np.ndarray, q: np.ndarray, di: np.ndarray, d: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, distance) of the k nearest rows of d to each row of q, ties by id, none of the same id.

    A tile of rows against columns is one matrix product in single precision, which is as good as the distance but for rounding; only
    columns that it puts within a row's k-th distance so far, with room for rounding, are measured as
    _square() does: a few of each tile but the first."""
    if metric == "cosine":
        q, d = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (q, d))
    rows, columns = np.flatnonzero(np.isfinite(q).all(1)), np.flatnonzero(np.isfinite(d).all(1))
    columns = columns[np.argsort(di[columns], kind="stable")]
    qi, q, di, d = qi[rows], q[rows], di[columns], d[columns]
    if not len(qi) or not len(di):
        return qi[:0], di[:0], np.empty(0)
    plain = metric != "cosine"
    shift = d.mean(0) if plain else 0.0
    a, b = q - shift, d - shift
    far, size = (a * a).sum(1), (b * b).sum(1)
    # numbers of about 1, so that no square is lost in single precision; what a product may be off by there
    unit = 2.0 ** -np.ceil(np.log2(max(far.max(), size.max(), 1e-300)) / 2)
    room = 2.0**-21 * (a.shape[1] + 4) * (far * unit * unit + size.max() * unit * unit)
    left, right = np.c_[-2 * a * unit, np.ones(len(a))].astype(np.float32), np.c_[b * unit, size * unit * unit if plain else np.zeros(len(b))].T.astype(np.float32, order="C")
    own, own_end = np.searchsorted(di, qi, "left"), np.searchsorted(di, qi, "right")
    out = []
    for low in range(0, len(qi), TILE[0]):
        at = np.arange(low, min(low + TILE[0], len(qi)))
        best, which = np.full((len(at), k), np.inf), np.full((len(at), k), -1)
        for first in range(0, len(di), TILE[1]):
            near = left[at] @ right[:, first : first + TILE[1]]
            width = near.shape[1]
            for j in range(int((own_end - own)[at].max())):
                c = own[at] + j
                mine = (c < own_end[at]) & (c >= first) & (c < first + width)
                near[mine, c[mine] - first] = np.inf
            kth = best[:, -1]
            limit = (kth * kth - far[at] if plain else 2 * kth - 2) * unit * unit + 2 * room[at]
            if first == 0 and width > k:
                limit = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * room[at]
            over = near > limit.astype(np.float32)[:, None]
            r, c = np.divmod(_few_true(np.logical_not(over, out=over)), width)
            for part in range(0, len(r), 1 << 18):
                pr, pc = r[part : part + (1 << 18)], c[part : part + (1 << 18)] + first
                _merge(best, which, pr, pc, at, qi, q, di, d, plain)
        r, c = np.nonzero(which >= 0)
        out.append((qi[at[r]], di[which[r, c]], best[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _few_true(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero() where next to nothing is true: eight at a time are looked at first."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = np.flatnonzero(flat.view(np.uint64))
    at, bit = np.nonzero(flat.reshape(-1, 8)[some])
    return some[at] * 8 + bit


def _merge(best: np.ndarray, which: np.ndarray, r: np.ndarray, c: np.ndarray, at: np.ndarray, qi: np.ndarray, q: np.ndarray, di: np.ndarray, d: np.ndarray, plain: bool) -> None:
    """Takes columns c of rows r into the rows' nearest so far, best by distance and column."""
    total = np.zeros(len(r))
    for x, y in zip(q.T, d.T, strict=True):
        total += (x[at[r]] - y[c]) ** 2 if plain else x[at[r]] * y[c]
    far = np.sqrt(total) if plain else 1 - total
    ok = np.isfinite(far) & (qi[at[r]] != di[c])
    r, c, far = r[ok], c[ok], far[ok]
    if not len(r):
        return
    k = best.shape[1]
    rows = np.unique(r)
    r, c, far = np.r_[r, np.repeat(rows, k)], np.r_[c, which[rows].ravel()], np.r_[far, best[rows].ravel()]
    order = np.lexsort((c, far, r))
    r, c, far = r[order], c[order], far[order]
    starts = np.searchsorted(r, rows)
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    best[r[rank < k], rank[rank < k]], which[r[rank < k], rank[rank < k]] = far[rank < k], c[rank < k]


def knn(points: DataFrame, k: int, keys: Sequence[str] = (), id_col: str = "vec_id", metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(keys, id, neighbour, distance, rank): the k nearest others, ties by id. metric: euclidean or cosine."""
    n = F.count(F.lit(1))
    size = points.groupBy(*keys).agg(F.ceil(n / block).alias("__qs"), F.ceil(n / (PANEL * block)).alias("__ds"))
    # a row a slice is broadcast: joined by shuffle, a slice's points would go through one task
    dealt = (points.join(F.broadcast(size), list(keys)) if keys else points.crossJoin(size)).select(*keys, F.col(id_col).alias("id"), "vec", "__qs", "__ds", F.xxhash64(id_col).alias("__h"))
    # each point once as a query against every panel, and once as data for every block's queries
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    query = F.transform(upto("__ds"), lambda o: F.struct(F.pmod("__h", "__qs").alias("qb"), o.alias("db"), F.lit(0).alias("side")))
    data = F.transform(upto("__qs"), lambda o: F.struct(o.alias("qb"), F.pmod("__h", "__ds").alias("db"), F.lit(1).alias("side")))
    dealt = dealt.select(*keys, "id", "vec", F.explode(F.concat(query, data)).alias("r")).select(*keys, "r.qb", "r.db", "id", "vec", "r.side")
    schema = ", ".join([*(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys), f"id {points.schema[id_col].dataType.simpleString()}", f"neighbour {points.schema[id_col].dataType.simpleString()}", "distance double"])

    def near(key, table):
        side = table.column("side").to_numpy()
        q, d = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        kind = table.schema.field("id").type
        qi, di = q.column("id").to_numpy(), d.column("id").to_numpy()
        u, v, far = _nearest(qi, _matrix(q), di, _matrix(d), k, metric) if len(qi) and len(di) else (qi[:0], di[:0], np.empty(0))
        out = {c: pa.array([v.as_py()] * len(u), table.schema.field(c).type) for c, v in zip(keys, key, strict=False)}
        return pa.table(out | {"id": pa.array(u, kind), "neighbour": pa.array(v, kind), "distance": pa.array(far, pa.float64())})

    # dealt out by pairs of blocks, not by the slices that the counts were joined on
    found = dealt.repartition(heavy(points.sparkSession), *keys, "qb", "db").groupBy(*keys, "qb", "db").applyInArrow(near, schema)
    w = Window.partitionBy(*keys, "id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_edges(neighbours: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(u, v, distance): undirected, each pair once with its least distance."""
    return neighbours.groupBy(*keys, F.least("id", "neighbour").alias("u"), F.greatest("id", "neighbour").alias("v")).agg(F.min("distance").alias("distance"))


def kernel_weights(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges with w = exp(-distance / median distance of the slice)."""
    cut = edges.groupBy(*keys).agg(F.percentile("distance", F.lit(0.5)).alias("__m"))
    rows = edges.join(cut, list(keys)) if keys else edges.crossJoin(F.broadcast(cut))
    return rows.withColumn("w", F.exp(-F.col("distance") / F.greatest("__m", F.lit(1e-12)))).drop("__m")


def mean_jaccard(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean Jaccard of two neighbour tables' sets over the ids of both."""
    sets = lambda t, name: t.groupBy(*keys, "id").agg(F.collect_set("neighbour").alias(name))
    rows = sets(a, "x").join(sets(b, "y"), [*keys, "id"])
    return rows.groupBy(*keys).agg(F.avg(X.jaccard("x", "y")).alias("mean_jaccard"), F.count(F.lit(1)).alias("n"))


def pairs(points: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id") -> DataFrame:
    """(u, v, x, y) of all pairs u < v of a slice; the slice is a bounded selection of points."""
    a = points.select(*keys, F.col(id_col).alias("u"), F.col("vec").alias("x"))
    b = points.select(*keys, F.col(id_col).alias("v"), F.col("vec").alias("y"))
    return (a.join(b, [*keys]) if keys else a.crossJoin(b)).where("u < v")


#: Points of a block and of a tile's rows and columns, where all pairs of a slice are measured; bits of a distance that a pass leaves open.
PAIRED, TILED, OPEN = 8192, (64, 1024), (44, 34, 0)


def _all_apart(table: pa.Table):
    """Distances of the pairs of ids of a block, or of one block's with another's, a tile at a time."""
    side = table.column("side").to_numpy()
    one, two = (table.filter(pa.array(side == x)) for x in (0, 1))
    own = table.column("p")[0] == table.column("q")[0]
    if not one.num_rows or not own and not two.num_rows:
        return
    one = one.sort_by("id")
    two = one if own else two
    ids, p, q = one.column("id").to_numpy(), _matrix(one), _matrix(two)
    first = np.searchsorted(ids, ids, "right")  # of the block itself: the larger ids
    for low in range(0, len(p), TILED[0]):
        rows = p[low : low + TILED[0]]
        for left in range(int(first[low]) if own else 0, len(q), TILED[1]):
            columns = q[left : left + TILED[1]]
            total, gap = np.zeros((len(rows), len(columns))), np.empty((len(rows), len(columns)))
            for x, y in zip(rows.T, columns.T, strict=True):
                np.subtract(x[:, None], y[None], out=gap)
                gap *= gap
                total += gap
            np.abs(np.sqrt(total, out=total), out=total)  # no number has a sign, nor has what is none
            if own and left < first[min(low + len(rows), len(p)) - 1]:
                yield total[np.arange(left, left + len(columns))[None] >= first[low : low + len(rows), None]]
            else:
                yield total.ravel()


def _counted(number: int):
    """Of a task's distances as whole numbers, which are in the same order, less the bits that pass `number` leaves open: (value, count) of
    those that begin as one of `at`, or of all in the first pass, and there (n, mean, m2) of the distances too."""
    upto = OPEN[number]

    def run(table):
        at = np.unique(np.array(table.column("at")[0].as_py(), np.int64)) if number else None
        values, counts, n, total, m2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0.0, 0.0
        for d in _all_apart(table):
            if not len(d):
                continue
            bits = d.view(np.int64)
            if number:
                for k in range(number):  # by the coarse beginning first
                    bits = bits[np.isin(bits >> OPEN[k], at >> (OPEN[k] - OPEN[number - 1]))]
                v, c = np.unique(bits >> upto, return_counts=True)
            else:
                v = bits >> upto
                low = int(v.min())
                c = np.bincount(v - low) if int(v.max()) - low < 1 << 20 else None
                v, c = (np.flatnonzero(c) + low, c[c > 0]) if c is not None else np.unique(v, return_counts=True)
                mean, k = float(d.mean()), len(d)
                gap = mean - total / n if n else 0.0
                m2 += float(((d - mean) ** 2).sum()) + gap * gap * n * k / (n + k)
                n, total = n + k, total + float(d.sum())
            values.append(v)
            counts.append(c)
            if sum(map(len, values)) > 1 << 22:
                v, of = np.unique(np.concatenate(values), return_inverse=True)
                values, counts = [v], [np.bincount(of, np.concatenate(counts), len(v)).astype(np.int64)]
        v, of = np.unique(np.concatenate(values), return_inverse=True)
        c = np.bincount(of, np.concatenate(counts), len(v)).astype(np.int64)
        return v, c, n, total / n if n else 0.0, m2

    return run


def pair_quantiles(points: DataFrame, shares: Sequence[float], keys: Sequence[str] = (), id_col: str = "vec_id") -> DataFrame:
    """(keys, pairs, q, mean, sd): exact quantiles, by linear interpolation, mean and deviation of the distances of all pairs
    of a slice's ids. No pair is a row: a task measures a block against a block and gives counts. A first pass counts by the distances' first
    bits, two more look within the counts that hold a quantile, the last by the whole distance."""
    keys, spark = list(keys), points.sparkSession
    size = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PAIRED).cast("long").alias("__n"))
    held = points.where("vec is not null").select(*keys, F.col(id_col).alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    held = written((held.join(size, keys) if keys else held.crossJoin(size)).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__n"))), "paired-points")
    ends = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda o: F.struct(F.least("__b", o).alias("p"), F.greatest("__b", o).alias("q"), (o < F.col("__b")).cast("int").alias("side")))
    names = [*keys, "value", "d", "n", "mean", "m2"]
    kinds = ", ".join([*(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys), "value long, d double, n long, mean double, m2 double"])
    parts = heavy(spark)

    def counted(number, at):
        count = _counted(number)

        def run(key, table):
            v, c, n, mean, m2 = count(table)
            extra = number == 0
            many = len(v) + extra
            none = [None] * len(v)
            out = {k: pa.array([x.as_py()] * many, table.schema.field(k).type) for k, x in zip(keys, key, strict=False)}
            out |= {"value": pa.array([*v.tolist(), *[None] * extra], pa.int64()), "d": pa.array([*(v.view(np.float64).tolist() if OPEN[number] == 0 else none), *[None] * extra], pa.float64())}
            out |= {"n": pa.array([*c.tolist(), *[n] * extra], pa.int64()), "mean": pa.array([*none, *[mean] * extra], pa.float64()), "m2": pa.array([*none, *[m2] * extra], pa.float64())}
            return pa.table(out).select(names)

        rows = held.withColumn("at", F.lit(None).cast("array<long>")) if at is None else held.join(at, keys) if keys else held.crossJoin(at)
        rows = rows.select(*keys, "id", "vec", "at", F.explode(ends).alias("e")).select(*keys, "id", "vec", "at", "e.*")
        # dealt out to a number of tasks, as these rows are few for the work in them
        return written(rows.repartition(parts, *keys, "p", "q").groupBy(*keys, "p", "q").applyInArrow(run, kinds), "pair-counts")

    first = counted(0, None)
    tasks = first.where("value is null and n > 0").select(*keys, "n", "mean", "m2")
    whole = tasks.groupBy(*keys).agg(F.sum("n").alias("pairs"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m")).where("pairs > 0")
    apart = (tasks.join(whole, keys) if keys else tasks.crossJoin(whole)).withColumn("m2", F.col("m2") + F.col("n") * (F.col("mean") - F.col("m")) * (F.col("mean") - F.col("m")))
    whole = written(apart.groupBy(*keys, "pairs", F.col("m").alias("__m")).agg(F.sqrt(F.sum("m2") / F.first("pairs")).alias("sd")).select(*keys, "pairs", F.col("__m").alias("mean"), "sd"), "pair-sums")
    spot = F.col("share") * (F.col("pairs") - 1)
    asked = whole.select(*keys, "pairs", F.explode(F.array(*map(F.lit, shares))).alias("share")).select(*keys, "share", spot.alias("spot"))
    sought = asked.select(*keys, F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot")))).alias("rank")).distinct()
    sought = sought.select(*keys, "rank", F.col("rank").alias("rest"), F.lit(0).cast("long").alias("begin"))
    for number in range(len(OPEN)):
        made = first if number == 0 else counted(number, sought.groupBy(*keys).agg(F.collect_set("begin").alias("at")))
        cut = F.lit(0).cast("long") if number == 0 else F.shiftright("value", OPEN[number - 1] - OPEN[number])
        sums = made.where("value is not null").groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.max("d").alias("d")).withColumn("begin", cut)
        w = Window.partitionBy(*keys, "begin").orderBy("value")
        sums = sums.withColumn("upto", F.sum("n").over(w))
        met = sought.select(*keys, "rank", "rest", "begin").join(sums, [*keys, "begin"]).where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
        sought = written(met.select(*keys, "rank", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), F.col("value").alias("begin"), "d"), "pair-ranks")
    at = lambda f, name: sought.select(*keys, F.col("rank").alias(f), F.col("d").alias(name))
    both = asked.withColumns({"low": F.floor("spot"), "high": F.ceil("spot")}).join(at("low", "x"), [*keys, "low"]).join(at("high", "y"), [*keys, "high"])
    value = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.col("high") - F.col("spot")) * F.col("x") + (F.col("spot") - F.col("low")) * F.col("y"))
    q = both.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("share", value.alias("v")))), lambda e: e["v"]).alias("q"))
    return (whole.join(q, keys) if keys else whole.crossJoin(q)).select(*keys, "pairs", "q", "mean", "sd")


def edge_vectors(edges: DataFrame, points: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id") -> DataFrame:
    """Edges (u, v) with their ends' vectors x and y."""
    a = points.select(*keys, F.col(id_col).alias("u"), F.col("vec").alias("x"))
    b = points.select(*keys, F.col(id_col).alias("v"), F.col("vec").alias("y"))
    return edges.join(a, [*keys, "u"]).join(b, [*keys, "v"])


def local_dimension(neighbours: DataFrame, keys: Sequence[str] = (), low: float = 0.1, high: float = 200.0) -> DataFrame:
    """(id, two_nn, mle): 1 / ln(r2 / r1), and (k - 1) / sum ln(rk / rj), clipped; null where points coincide."""
    r = F.greatest("distance", F.lit(1e-12))
    far = F.max("distance")
    at = lambda n: F.max(F.when(F.col("rank") == n, r))
    g = neighbours.groupBy(*keys, "id").agg(at(1).alias("r1"), at(2).alias("r2"), far.alias("rk"), F.count(F.lit(1)).alias("k"), F.sum(F.ln(r)).alias("s"))
    clip = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    two = F.when(F.col("r2") > F.col("r1"), clip(1 / F.ln(F.col("r2") / F.col("r1"))))
    sums = F.col("k") * F.ln("rk") - F.col("s")
    return g.select(*keys, "id", two.alias("two_nn"), F.when(sums > 1e-12, clip((F.col("k") - 1) / sums)).alias("mle"))


def dimension_sums(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(dim, mean, var): sample variance of each dimension."""
    return points.select(*keys, F.posexplode("vec").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def participation_ratio(points: DataFrame, keys: Sequence[str] = (), top: int = 5) -> DataFrame:
    """(participation_ratio, linearity): (sum of variances)^2 over the sum of squares, and the share of
    the first `top` dimensions, which for projected points are the principal ones."""
    v = dimension_sums(points, keys)
    s = F.sum("var")
    return v.groupBy(*keys).agg((s * s / F.sum(F.col("var") * F.col("var"))).alias("participation_ratio"), (F.sum(F.when(F.col("dim") < top, F.col("var"))) / s).alias("linearity"))


def local_participation_ratio(neighbours: DataFrame, points: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id") -> DataFrame:
    """(id, ratio): (tr C)^2 / tr C^2 of the covariance of each point's neighbours, from sums of
    products; tr C^2 is the sum of the squares of C's entries."""
    p = points.select(*keys, F.col(id_col).alias("neighbour"), "vec")
    long = neighbours.join(p, [*keys, "neighbour"]).select(*keys, "id", "neighbour", F.posexplode("vec").alias("d", "x"))
    w = Window.partitionBy(*keys, "id", "d")
    c = long.withColumn("c", F.col("x") - F.avg("x").over(w)).select(*keys, "id", "neighbour", "d", "c")
    prod = c.join(c.select(*keys, "id", "neighbour", F.col("d").alias("e"), F.col("c").alias("b")), [*keys, "id", "neighbour"])
    cov = prod.groupBy(*keys, "id", "d", "e").agg(F.sum(F.col("c") * F.col("b")).alias("v"))
    trace = F.sum(F.when(F.col("d") == F.col("e"), F.col("v")))
    return cov.groupBy(*keys, "id").agg((trace * trace / F.greatest(F.sum(F.col("v") * F.col("v")), F.lit(1e-18))).alias("ratio"))


def section_shape(neighbours: DataFrame, points: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id") -> DataFrame:
    """(id, anisotropy, planarity, omnivariance, axis) of each point's neighbours, from the three largest eigenvalues
    a >= b >= c of their covariance, none under 1e-8: (a - b) / (a + b + c), (b - c) / a, the cube root of abc over
    a + b + c, and the first eigenvector. All zero with fewer than three neighbours."""
    p = points.select(*keys, F.col(id_col).alias("neighbour"), F.col("vec").alias("nv"))
    rows = neighbours.join(p, [*keys, "neighbour"]).groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("rank", "nv"))).alias("near"))
    rows = rows.select(*keys, "id", F.transform("near", lambda x: x["nv"]).alias("near"))
    names = [*keys, "id", "anisotropy", "planarity", "omnivariance", "axis"]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "id"]), "anisotropy double, planarity double, omnivariance double, axis array<double>"])

    def run(batches):
        for b in batches:
            out = []
            for near in b.column("near").to_pylist():
                n = np.array(near, float)
                if len(n) < 3:
                    out.append((0.0, 0.0, 0.0, [0.0] * n.shape[1]))
                    continue
                lam, axes = np.linalg.eigh(np.cov(n.T).reshape(n.shape[1], n.shape[1]))
                top = np.maximum(np.pad(lam[::-1], (0, max(0, 3 - len(lam))))[:3], 1e-8)
                total = top.sum()
                out.append((float((top[0] - top[1]) / total), float((top[1] - top[2]) / top[0]), float(np.cbrt(top.prod()) / total), axes[:, -1].tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keys, "id"]), *(pa.array(c, pa.float64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.float64()))], names)

    return rows.mapInArrow(run, schema)


def local_shape(neighbours: DataFrame, points: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id", ridge: float = 1e-3) -> DataFrame:
    """(id, anisotropy, planarity, omnivariance, residual, tail_share): eigenvalues of each point's
    neighbourhood, and how well its neighbours rebuild it (relative error of ridge weights)."""
    p = points.select(*keys, F.col(id_col).alias("neighbour"), F.col("vec").alias("nv"))
    own = points.select(*keys, F.col(id_col).alias("id"), F.col("vec").alias("ov"))
    rows = neighbours.join(p, [*keys, "neighbour"]).groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct("rank", "nv"))).alias("near")).join(own, [*keys, "id"])
    rows = rows.select(*keys, "id", "ov", F.transform("near", lambda x: x["nv"]).alias("near"))
    names = [*keys, "id", "anisotropy", "planarity", "omnivariance", "residual", "tail_share"]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*keys, "id"]), *(f"{c} double" for c in names[len(keys) + 1 :])])

    def run(batches):
        for b in batches:
            out = []
            for o, near in zip(b.column("ov").to_pylist(), b.column("near").to_pylist(), strict=True):
                n, o = np.array(near), np.array(o)
                lam = np.linalg.svd(n - n.mean(0), compute_uv=False) ** 2 / max(1, len(n) - 1)
                lam = np.maximum(np.pad(lam, (0, max(0, 3 - len(lam)))), 1e-12)
                g = (n - o) @ (n - o).T
                w = np.linalg.solve(g + ridge * max(np.trace(g), 1e-12) * np.eye(len(n)), np.ones(len(n)))
                w /= w.sum() if abs(w.sum()) > 1e-12 else 1.0
                scale = ((o - n.mean(0)) ** 2).sum()
                out.append((float(np.log1p(lam[0] / lam[-1])), float((lam[1] - lam[2]) / lam[0]), float(np.prod(lam[:3]) ** (1 / 3)),
                            float(((o - w @ n) ** 2).sum() / max(scale, 1e-12)), float(1 - lam[:2].sum() / lam.sum())))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keys, "id"]), *(pa.array(c, pa.float64()) for c in zip(*out, strict=True))], names)

    return rows.mapInArrow(run, schema)


def column_zscores(points: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id", sample: bool = False) -> DataFrame:
    """Every dimension at mean 0 and deviation 1 within its slice, 0 where it is flat."""
    long = points.select(*keys, id_col, F.posexplode("vec").alias("dim", "x"))
    z = long.withColumn("z", zscore("x", [*keys, "dim"], 1e-8, sample))
    return z.groupBy(*keys, id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "z"))), lambda s: s["z"]).alias("vec"))


def centroids(points: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """(group, n, vec): mean vector of each group."""
    long = points.select(*keys, group, F.posexplode("vec").alias("dim", "x"))
    m = long.groupBy(*keys, group, "dim").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(*keys, group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("vec"))


def project(points: DataFrame, n: int, keys: Sequence[str] = (), id_col: str = "vec_id") -> DataFrame:
    """The n principal components of each slice: the covariance is summed by Spark, its eigenvectors are
    found on d x d numbers, and rows are rotated in place. Signs make each vector's largest entry positive."""
    long = points.select(*keys, F.col(id_col).alias("id"), F.posexplode("vec").alias("d", "x"))
    mean = long.groupBy(*keys, "d").agg(F.avg("x").alias("m"))
    pair = points.select(*keys, F.posexplode("vec").alias("d", "x"), "vec").select(*keys, "d", "x", F.posexplode("vec").alias("e", "y"))
    second = pair.groupBy(*keys, "d", "e").agg(F.avg(F.col("x") * F.col("y")).alias("s"))
    stats = second.join(mean, [*keys, "d"]).join(mean.select(*keys, F.col("d").alias("e"), F.col("m").alias("me")), [*keys, "e"]).withColumn("c", F.col("s") - F.col("m") * F.col("me"))
    stats = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "e", "c", "m"))).alias("s"))  # d * d numbers a slice
    rows = points.join(stats, list(keys)) if keys else points.crossJoin(stats)
    out = rows.select(*keys, F.col(id_col), "vec", "s")
    names = [*keys, id_col, "vec"]
    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        known: dict[tuple, tuple] = {}
        for b in batches:
            made = []
            of = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True)) if keys else [()] * b.num_rows
            for i, (k, v) in enumerate(zip(of, b.column("vec").to_pylist(), strict=True)):
                if k not in known:
                    s = b.column("s")[i].as_py()
                    d = max(x["d"] for x in s) + 1
                    c = np.array([x["c"] for x in s]).reshape(d, d)
                    lam, vec = np.linalg.eigh(c)
                    vec = vec[:, np.argsort(-lam)[:n]]
                    vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])])
                    known[k] = (np.array([x["m"] for x in s]).reshape(d, d)[:, 0], vec)
                m, vec = known[k]
                made.append(((np.array(v) - m) @ vec).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(made, pa.list_(pa.float64()))], names)

    return out.mapInArrow(run, schema)
