"""Shortest paths and spanning forests of graphs that are larger than a task, in rounds over edge tables.

Edges are undirected, (keys, u, v, w) with w >= 0; all slices go through the rounds together, and what a
round leaves is written to the checkpoint folder. A round is joins and aggregates over rows of the
frontier, so a slice is spread over tasks like any table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import graph, vectors
from . import kernels as K

#: Sources whose paths one task works out.
SOURCES = 2048


def both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b, w): each edge from both ends, the lightest of parallel ones, without loops."""
    there = edges.where("u <> v").select(*keys, F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), "w"), F.struct(F.col("v").alias("a"), F.col("u").alias("b"), "w"))).alias("e"))
    return there.select(*keys, "e.*").groupBy(*keys, "a", "b").agg(F.min("w").alias("w"))


def shortest(edges: DataFrame, pairs: DataFrame, keys: Sequence[str] = (), width: float = 4.0) -> DataFrame:
    """(keys, source, target, distance) of the pairs (keys, source, target): lengths of shortest paths, null where there is none.

    Delta-stepping from the sources alone: a round goes on from those nodes whose distance has come down since
    they were last gone on from and is within `width` mean edges of the source's least such. A source is done
    when no such node is nearer than its farthest target."""
    keys = list(keys)
    pairs = graph.written(pairs.select(*keys, "source", "target").distinct(), "path-pairs")
    links = graph.written(both_ways(edges, keys), "path-links")
    mean = links.groupBy(*keys).agg((F.avg("w") * width).alias("width"))  # a row a slice
    wanted = pairs.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("wanted"))
    sources = wanted.join(mean, keys, "left") if keys else wanted.crossJoin(F.broadcast(mean))
    sources = graph.written(sources.withColumn("width", F.coalesce("width", F.lit(0.0))), "path-sources")
    state = graph.written(sources.select(*keys, "source", F.col("source").alias("node"), F.lit(0.0).alias("d"), F.lit(True).alias("open")), "path-state")
    of = [*keys, "source"]
    while True:
        hits = pairs.select(*of, F.col("target").alias("node"), F.lit(True).alias("aim"))
        seen = state.join(hits, [*of, "node"], "left").groupBy(*of).agg(F.min(F.when(F.col("open"), F.col("d"))).alias("low"), F.count("aim").alias("hit"), F.max(F.when(F.col("aim"), F.col("d"))).alias("far"))
        bound = sources.join(seen, of).select(*of, (F.col("low") + F.col("width")).alias("upto"), F.when(F.col("hit") == F.col("wanted"), F.col("far")).otherwise(F.lit(float("inf"))).alias("limit"))
        bound = bound.where("upto is not null")  # others have gone on from all they know
        marked = state.join(bound, of, "left")
        front = F.coalesce(F.col("open") & (F.col("d") <= F.col("upto")) & (F.col("d") < F.col("limit")), F.lit(False))
        marked = graph.written(marked.select(*of, "node", "d", "open", front.alias("front")), "path-front")
        ahead = marked.where("front")
        if ahead.isEmpty():
            break
        steps = ahead.select(*of, F.col("node").alias("a"), "d").join(links, [*keys, "a"]).groupBy(*of, F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        # of equal distances the one that was there stays as it is
        old = marked.select(*of, "node", F.struct("d", F.lit(0).alias("k"), (F.col("open") & ~F.col("front")).alias("open")).alias("x"))
        new = steps.select(*of, "node", F.struct("d", F.lit(1).alias("k"), F.lit(True).alias("open")).alias("x"))
        state = graph.written(old.unionByName(new).groupBy(*of, "node").agg(F.min("x").alias("x")).select(*of, "node", "x.d", "x.open"), "path-state")
    return pairs.join(state.select(*of, F.col("node").alias("target"), F.col("d").alias("distance")), [*of, "target"], "left").select(*of, "target", "distance")


def spanning_forest(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, u, v, w), u < v: the edges of the lightest spanning forest, ties by (u, v).

    Borůvka rounds: every part takes its least edge to another part, the parts that meet become one, and of the
    edges between two parts only the least goes on; the number of parts at least halves."""
    keys = list(keys)
    left = edges.where("u <> v").groupBy(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    left = graph.written(left.select(*keys, F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e")), "forest-edges")
    taken = left.limit(0).select(*keys, "e")
    while not left.isEmpty():
        ends = left.select(*keys, F.explode(F.array("a", "b")).alias("part"), "a", "b", "e")
        least = ends.groupBy(*keys, "part").agg(F.min(F.struct("e", "a", "b")).alias("x"))
        chosen = graph.written(least.select(*keys, "x.*").distinct(), "forest-chosen")
        taken = taken.unionByName(chosen.select(*keys, "e"))
        merged = graph.components(chosen.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")), keys)
        to = lambda end: merged.select(*keys, F.col("node").alias(end), F.col("component").alias(f"to_{end}"))  # noqa: E731, B023
        moved = left.join(to("a"), [*keys, "a"]).join(to("b"), [*keys, "b"]).where("to_a <> to_b")
        pair = [F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")]
        left = graph.written(moved.groupBy(*keys, *pair).agg(F.min("e").alias("e")), "forest-edges")
    return taken.select(*keys, "e.u", "e.v", "e.w")


def zero_bars(forest: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, birth, death): the bars of connected parts of a cloud whose points are there from 0: a bar ends at each
    edge of the spanning forest, and one of each part that stays apart never does (null)."""
    keys = list(keys)
    ended = forest.select(*keys, F.lit(0.0).alias("birth"), F.col("w").alias("death"))
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = forest.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    both = n.join(m, keys, "left") if keys else n.crossJoin(F.broadcast(m))  # one row each
    endless = both.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.coalesce("m", F.lit(0)))).alias("i"))
    return ended.unionByName(endless.select(*keys, F.lit(0.0).alias("birth"), F.lit(None).cast("double").alias("death")))


def bridges(points: DataFrame, parts: DataFrame, keys: Sequence[str], id_col: str = "vec_id") -> DataFrame:
    """(keys, u, v, w): for parts (keys, node, component) of a slice, the shortest edges that join them, as adding the
    shortest edge between two parts until there is one would. Points outside a slice's largest part meet the
    points of the other parts; a slice in one part makes no rows."""
    keys = list(keys)
    sizes = parts.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy(*keys).agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rows = points.select(*keys, F.col(id_col).alias("node"), "vec").join(parts, [*keys, "node"]).join(top.select(*keys, F.col("top.component").alias("top")), keys)
    a = rows.where("component <> top").select(*keys, F.col("node").alias("i"), F.col("vec").alias("x"), F.col("component").alias("ca"))
    b = rows.select(*keys, F.col("node").alias("j"), F.col("vec").alias("y"), F.col("component").alias("cb"))
    met = a.join(b, keys).where("ca <> cb").select(*keys, F.least("ca", "cb").alias("u"), F.greatest("ca", "cb").alias("v"), F.struct(X.distance("x", "y").alias("w"), F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).alias("e"))
    best = graph.written(met.groupBy(*keys, "u", "v").agg(F.min("e").alias("e")), "bridge-pairs")
    chosen = spanning_forest(best.select(*keys, "u", "v", F.col("e.w").alias("w")), keys)
    return chosen.join(best, [*keys, "u", "v"]).select(*keys, "e.u", "e.v", "e.w")


def neighbour_links(points: DataFrame, k: int, keys: Sequence[str], id_col: str = "vec_id") -> DataFrame:
    """(keys, u, v, w, bridge): each point's k nearest as edges, and the bridges that make every slice one part."""
    keys = list(keys)
    near = vectors.knn_edges(vectors.knn(points, k, keys, id_col), keys).select(*keys, "u", "v", F.col("distance").alias("w"), F.lit(False).alias("bridge"))
    near = graph.written(near, "neighbour-edges")
    parts = graph.components(near.select(*keys, "u", "v"), keys, points.select(*keys, F.col(id_col).alias("node")))
    if parts.groupBy(*keys).agg(F.count_distinct("component").alias("n")).where("n > 1").isEmpty():
        return near
    return graph.written(near.unionByName(bridges(points, parts, keys, id_col).withColumn("bridge", F.lit(True))), "neighbour-links")


def neighbour_graph(points: DataFrame, k: int, keys: Sequence[str], id_col: str = "vec_id") -> DataFrame:
    """(keys, u, v, w) of neighbour_links()."""
    return neighbour_links(points, k, keys, id_col).drop("bridge")


def in_parts(points: DataFrame, links: DataFrame, pairs: DataFrame, keys: Sequence[str], fn: Callable, schema: Sequence[str], parts: Column, part: Column, id_col: str = "vec_id", more: DataFrame | None = None) -> DataFrame:
    """Rows of fn(ids, vectors, graph, near, u, v, own), a dict of columns, for each part of a slice's pairs (keys, source, target).

    A task has the slice's points, in order of id, and links (keys, u, v, w, bridge), some hundred bytes a point, and one
    part of the pairs: `parts` gives their number from the slice's points `__n`, `part` a pair's from that number
    `__parts`. near: (u, v, w) without bridges; u, v: positions of the pairs' ends; own: the pairs' table. With rows (keys, u, v, w) of `more`, which are
    no links, fn has them as its argument `more`, as (u, v, w)."""
    keys = list(keys)
    names = [c.split()[0] for c in schema]
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, parts.cast("long").alias("__parts"))
    size = F.broadcast(graph.written(size, "parts"))  # a row a slice
    sized = lambda df: df.join(size, keys) if keys else df.crossJoin(size)
    left = sized(pairs).withColumn("__part", part.cast("long")).drop("__parts")
    asked = graph.written(left, "path-pairs")
    there = F.broadcast(asked.select(*keys, "__part").distinct())  # a row a task
    kind = points.schema[id_col].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    cloud = points.select(*keys, F.col(id_col).alias("u"), none(kind).alias("v"), none("double").alias("w"), none("boolean").alias("bridge"), F.col("vec").cast("array<double>").alias("vec"))
    right = cloud.unionByName(links.select(*keys, F.col("u").cast(kind), F.col("v").cast(kind), "w", "bridge", none("array<double>").alias("vec")))
    if more is not None:  # told from links by the bridge that they lack
        right = right.unionByName(more.select(*keys, F.col("u").cast(kind), F.col("v").cast(kind), "w", none("boolean").alias("bridge"), none("array<double>").alias("vec")))
    right = right.join(there, keys) if keys else right.crossJoin(there)
    extra = more is not None

    def run(key, left, right):
        made = None
        if left.num_rows:
            edge = pc.is_valid(right.column("v"))
            rows, ends = right.filter(pc.invert(edge)).sort_by("u"), right.filter(edge)
            ids, p = rows.column("u").to_numpy(), vectors._matrix(rows)
            beside = {}
            if extra:
                kept = pc.is_valid(ends.column("bridge"))
                own, ends = ends.filter(pc.invert(kept)), ends.filter(kept)
                own = own.filter(pa.array(np.isin(own.column("u").to_numpy(), ids) & np.isin(own.column("v").to_numpy(), ids)))
                beside["more"] = np.searchsorted(ids, own.column("u").to_numpy()), np.searchsorted(ids, own.column("v").to_numpy()), own.column("w").to_numpy()
            u, v, w = np.searchsorted(ids, ends.column("u").to_numpy()), np.searchsorted(ids, ends.column("v").to_numpy()), ends.column("w").to_numpy()
            own = left.filter(pa.array(np.isin(left.column("source").to_numpy(), ids) & np.isin(left.column("target").to_numpy(), ids))).sort_by([("source", "ascending"), ("target", "ascending")])
            bridge = ends.column("bridge").to_numpy(zero_copy_only=False).astype(bool)
            if own.num_rows:
                made = fn(ids, p, K.Links(len(ids), u, v, w), (u[~bridge], v[~bridge], w[~bridge]), np.searchsorted(ids, own.column("source").to_numpy()), np.searchsorted(ids, own.column("target").to_numpy()), own, **beside)
        n = len(made[names[0]]) if made else 0
        types = {c.name: c.type for c in left.schema}
        out = {c: pa.array([x.as_py()] * n, types[c]) for c, x in zip(keys, key, strict=False)}
        return pa.table(out | ({c: pa.array(made[c]) if not isinstance(made[c], (pa.Array, pa.ChunkedArray)) else made[c] for c in names} if made else {c: pa.array([], _ARROW.get(t, types["source"])) for c, t in (x.split() for x in schema)}))

    by = [*keys, "__part"]
    # dealt out anew: a union's parts may have been dealt out each in its own way
    right = right.select(*[F.col(c).alias(c) for c in right.columns]).repartition(graph.heavy(points.sparkSession), *by)
    spec = ", ".join([*(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys), *schema])
    return asked.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, spec)


_ARROW = {"double": pa.float64(), "long": pa.int64()}


def by_source(per: int = SOURCES) -> dict[str, Column]:
    """Parts of about `per` sources."""
    return {"parts": F.ceil(F.col("__n") / per), "part": F.pmod(F.xxhash64("source"), F.col("__parts"))}


def _runs(at: np.ndarray, width: int):
    """(sources, from, to) of runs of a sorted array with at most `width` values."""
    values, starts = np.unique(at, return_index=True)
    ends = np.r_[starts[1:], len(at)]
    for low in range(0, len(values), width):
        yield values[low : low + width], starts[low], ends[min(low + width, len(values)) - 1]


def edge_geodesics(points: DataFrame, edges: DataFrame, keys: Sequence[str], k: int = 12, id_col: str = "vec_id") -> DataFrame:
    """(keys, u, v, euclidean, geodesic) of edges (keys, u, v), over the joined neighbour graph; a task works out the
    paths from some of the edges' ends."""
    keys = list(keys)

    def run(ids, p, links, near, u, v, own):
        del ids, near
        far = np.empty(len(u))
        for nodes, low, high in _runs(u, 64):
            far[low:high] = links.distances(nodes)[np.searchsorted(nodes, u[low:high]), v[low:high]]
        straight = vectors.apart(p[u], p[v])
        return {"u": own.column("source"), "v": own.column("target"), "euclidean": straight, "geodesic": pa.array(far, mask=~np.isfinite(far))}

    kind = points.schema[id_col].dataType.simpleString()
    pairs = edges.select(*keys, F.col("u").cast(kind).alias("source"), F.col("v").cast(kind).alias("target")).distinct()
    return in_parts(points, neighbour_links(points, k, keys, id_col), pairs, keys, run, [f"u {kind}", f"v {kind}", "euclidean double", "geodesic double"], id_col=id_col, **by_source())


def distortion(points: DataFrame, keys: Sequence[str], k: int = 12, id_col: str = "vec_id", links: DataFrame | None = None) -> DataFrame:
    """(keys, total, pairs): geodesic over Euclidean distance, summed over all pairs of points that are apart, and their
    number. Pairs are summed where a source's paths are worked out and are never rows. links: those of neighbour_links(), if there already."""
    keys = list(keys)

    def run(ids, p, links, near, u, v, own):
        del ids, near, v, own
        total, n = 0.0, 0
        for nodes, _, _ in _runs(u, 64):
            g = links.distances(nodes)
            d = vectors._square(p[nodes], p, "euclidean")
            ok = (np.arange(len(p))[None, :] > nodes[:, None]) & (d > 1e-9) & np.isfinite(g)
            total, n = total + float((g[ok] / d[ok]).sum()), n + int(ok.sum())
        return {"total": np.array([total]), "pairs": np.array([n])}

    own = points.select(*keys, F.col(id_col).alias("source"), F.col(id_col).alias("target"))
    sums = in_parts(points, neighbour_links(points, k, keys, id_col) if links is None else links, own, keys, run, ["total double", "pairs long"], id_col=id_col, **by_source())
    return sums.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
