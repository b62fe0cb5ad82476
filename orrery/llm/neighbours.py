"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, greedy search walks it.

Rows with equal vectors are one node, so that a vector shared by very many rows is compared once; a
node keeps the `keep` least ids of its rows, which are all that a result of fewer rows can name. Nodes
are numbered along a random-projection order, and a cell is `CELL` successive numbers: every step
brings to one task the lists of one cell and each code they name once, whatever the data look like.

A round of NN-descent joins every node's neighbours, and the nodes it is a neighbour of, with each
other: two of them, one new since the last round, meet at that node, and the nearer pairs go to both
ends, which keep their `k` nearest. Rounds end when few entries change. A search starts at a node's
own place, or at the nearest of some entries, and opens the nodes of its beam until all are open.
Lists and beams hold vectors as unit vectors of half precision; what a search returns is scored
anew on the original vectors in double precision.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id and vectors of another length than most (the longer, if as many). Repeated rows are
rows of their own: a query leaves out one row of its id and vector, itself. Ties fall to the smaller
id. Empty tables give empty results; columns other than the id and the vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import broadcast_if, join_counted, stored, tidy

#: Nodes of a cell.
CELL = 2048
#: Nodes of a leaf, within which all are compared to begin with.
LEAF = 512
#: So many rows of a search's frontier (some 100 bytes each) are broadcast at most.
BROADCAST_FRONTIER = 200_000
#: Entries of a graph, for queries that are not its rows.
ENTRIES = 256


def _usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _codes(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of half precision. Scaled by the largest part first, so that no square overflows."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float16)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column, dtype=np.float16) -> np.ndarray:
    """A column of binaries of one length as rows of float32."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return flat.view(dtype).reshape(len(column), -1).astype(np.float32)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of numbers: the row of each entry and its value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _nearest(owner: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of each owner's `most` nearest others, each once, by owner and from the nearest."""
    order = np.lexsort((other, owner))
    o, c = owner[order], other[order]
    order = order[np.concatenate(([True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])))] if len(order) else order
    order = order[np.lexsort((other[order], -score[order], owner[order]))]
    o = owner[order]
    return order[np.arange(len(o)) - np.searchsorted(o, o) < most]


def _packed(owner: np.ndarray, other: np.ndarray, score: np.ndarray, most: int, size: int) -> pa.Table:
    """The `most` nearest of each owner, a row for each cell (of `size` nodes) of owners."""
    at = _nearest(owner, other, score, most)
    cell, sizes = np.unique(owner[at] // size, return_counts=True)
    lists = {k: _lists(sizes, x[at], kind) for k, x, kind in (("n", owner, pa.int64()), ("c", other, pa.int64()), ("s", score.astype(np.float32), pa.float32()))}
    return pa.table({"cell": cell, **lists})


FOUND = "cell long, n array<bigint>, c array<bigint>, s array<float>"


def _leaf(most: int, size: int):
    def run(rows: pa.Table) -> pa.Table:
        n, m = rows["n"].to_numpy(), _matrix(rows["code"])
        if len(n) < 2:
            return _packed(n[:0], n[:0], np.zeros(0, np.float32), most, size)
        score = m @ m.T
        np.fill_diagonal(score, -2)
        k = min(most, len(n) - 1)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return _packed(np.repeat(n, k), n[near].ravel(), np.take_along_axis(score, near, 1).ravel(), most, size)

    return run


SERVED = "cell long, n array<bigint>, code binary, least array<float>"


def _serve(asked: pa.Table, codes: pa.Table) -> pa.Table:
    """For each cell that asks, the codes of those of this cell's nodes that it names, as one row."""
    by, lists = asked["by"], asked["n"].combine_chunks()
    order = np.argsort(codes["n"].to_numpy())
    ids, m, least = codes["n"].to_numpy()[order], _matrix(codes["code"]).astype(np.float16)[order], codes["least"].to_numpy()[order]
    row, n = _flat(lists)
    at = np.searchsorted(ids, n)
    ends = np.searchsorted(row, np.arange(len(by) + 1))
    blobs = [m[at[ends[i] : ends[i + 1]]].tobytes() for i in range(len(by))]
    return pa.table({"cell": by, "n": _lists(np.diff(ends), n, pa.int64()), "code": pa.array(blobs, pa.binary()), "least": _lists(np.diff(ends), least[at], pa.float32())})


def _meet(width: int, cell: int):
    """At each node of a cell, the members of its list meet; a pair goes to an end where it is nearer than the
    farthest that end has, the `width` nearest of a node and list, and of a node and cell."""

    def run(lists: pa.Table, members: pa.Table) -> pa.Table:
        if not lists.num_rows or not members.num_rows:
            return _packed(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), width, cell)
        ids = _flat(members["n"])[1]
        order = np.argsort(ids)
        codes = np.frombuffer(b"".join(members["code"].to_pylist()), np.float16).reshape(len(ids), -1).astype(np.float32)[order]
        ids, least = ids[order], _flat(members["least"])[1][order]
        row, c = _flat(lists["c"])
        new = _flat(lists["fresh"])[1].astype(bool)
        order = np.lexsort((~new, c, row))  # an entry that is there twice is new if either is
        row, c, new = row[order], c[order], new[order]
        once = np.concatenate(([True], (row[1:] != row[:-1]) | (c[1:] != c[:-1])))
        row, c, new = row[once], np.searchsorted(ids, c[once]), new[once]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        size = int(place.max()) + 1
        at = np.full((lists.num_rows, size), -1, np.int64)
        fresh = np.zeros((lists.num_rows, size), bool)
        at[row, place], fresh[row, place] = c, new
        found = []
        for k in range(0, len(at), 64):
            a, f = at[k : k + 64], fresh[k : k + 64]
            m = codes[a]
            s = m @ m.transpose(0, 2, 1)
            s[~(f[:, :, None] | f[:, None, :])] = -2
            s[np.broadcast_to((a < 0)[:, None, :], s.shape)] = -2
            s[:, np.arange(size), np.arange(size)] = -2
            s[s <= least[a][:, :, None]] = -2
            s[a < 0] = -2
            if size > width:
                best = np.argpartition(-s, width - 1, axis=2)[:, :, :width]
                s, other = np.take_along_axis(s, best, 2), np.take_along_axis(np.broadcast_to(a[:, None, :], s.shape), best, 2)
            else:
                other = np.broadcast_to(a[:, None, :], s.shape)
            i, j, x = np.nonzero(s > -2)
            found.append((a[i, j], other[i, j, x], s[i, j, x]))
        owner, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return _packed(ids[owner], ids[other], score, 2 * width, cell)

    return run


GRAPH = "cell long, n long, c array<bigint>, s array<float>, fresh array<boolean>, least float"


def _take(most: int, size: int):
    """The lists of a cell's nodes with what has been found for them: the `most` nearest, and which are fresh."""

    def run(lists: pa.Table, found: pa.Table) -> pa.Table:
        row, c = _flat(lists["c"])
        sides = [(lists["n"].to_numpy()[row], c, _flat(lists["s"])[1], np.zeros(len(c), np.int8))]
        c = _flat(found["c"])[1]
        sides.append((_flat(found["n"])[1], c, _flat(found["s"])[1], np.ones(len(c), np.int8)))
        owner, other, score, side = (np.concatenate(x) for x in zip(*sides, strict=True))
        # what was there before comes first of equal entries, so that it doesn't count as fresh
        order = np.argsort(side, kind="stable")
        owner, other, score, side = owner[order], other[order], score[order], side[order]
        at = _nearest(owner, other, score, most)
        n, starts, sizes = np.unique(owner[at], return_index=True, return_counts=True)
        kept = score[at]
        least = np.where(sizes < most, np.float32(-1.5), kept[starts + sizes - 1]) if len(n) else np.zeros(0, np.float32)
        return pa.table(
            {
                "cell": n // size,
                "n": n,
                "c": _lists(sizes, other[at], pa.int64()),
                "s": _lists(sizes, kept, pa.float32()),
                "fresh": _lists(sizes, side[at] == 1, pa.bool_()),
                "least": pa.array(least, pa.float32()),
            }
        )

    return run


def _cell(n: Column, size: int) -> Column:
    return F.floor(n / size).cast("long")


def _mean(nodes: DataFrame, dim: int) -> np.ndarray:
    """The mean of the unit vectors, from the sums of each batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes = _codes(b["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim))
                yield pa.RecordBatch.from_arrays([pa.array([codes.astype(np.float64).sum(0).tolist()]), pa.array([b.num_rows])], ["s", "rows"])

    parts = nodes.select("vec").mapInArrow(tidy(run), "s array<double>, rows long").select("rows", F.posexplode("s").alias("i", "x"))
    sums = parts.groupBy("i").agg((F.sum("x") / F.sum("rows")).alias("m")).orderBy("i").collect()  # a row a dimension
    return np.array([x.m for x in sums] or [0.0] * dim, np.float32)


def _encoded(nodes: DataFrame, dim: int, mean: np.ndarray, seed: int) -> DataFrame:
    """Nodes with their code and place in the order of a random projection: the sides of 20 hyperplanes
    through the mean, then a projection."""
    kind = next(f for f in nodes.schema.fields if f.name == "node")
    planes = np.random.default_rng(seed).standard_normal((dim, 21)).astype(np.float32)

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes = _codes(b["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)) if "vec" in b.schema.names else None
                code = b["code"] if codes is None else _binary(codes)
                side = (_matrix(code) - mean) @ planes
                sign = (side[:, :20] > 0) @ (1 << np.arange(19, -1, -1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b["node"], code.cast(pa.binary()), pa.array(sign), pa.array(side[:, 20].astype(np.float64))], ["node", "code", "__sign", "__along"])

    return nodes.mapInArrow(tidy(run), f"node {kind.dataType.simpleString()}, code binary, __sign long, __along double")


def _placed(df: DataFrame, out: str) -> DataFrame:
    """Places from 0 in the order of (__sign, __along, node), by ranges and their counts."""
    order = ["__sign", "__along", "node"]
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "ann-order")
    part = F.shiftright("__row", 33)
    before, starts = 0, []
    for p, n in sorted(ranged.groupBy(part.alias("p")).count().collect()):  # a row a range
        starts.append((p, before))
        before += n
    moved = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "__part long, __before long"))
    within = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("__part", part).join(moved, "__part").withColumn(out, within + F.col("__before")).drop("__part", "__before", "__row", *order[:2])


def classes(vectors: DataFrame, id_col: str, vec_col: str, keep: int) -> DataFrame:
    """Table (node, vec array<double>, ids): one row for equal vectors, node the least id that no other has with
    another vector (a number of its own), ids the `keep` least ids of its rows. Least ids are found by
    salted parts first, so that no task gets all rows of a vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null").where(_usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    rows = rows.where(F.size("vec") == (sizes[0] if sizes else -1))
    ids = F.slice(F.sort_array(F.collect_list("id")), 1, keep)
    parts = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1024)).alias("fine")).agg(ids.alias("ids"))
    some = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep)
    whole = parts.groupBy("vec", "salt").agg(some.alias("ids")).groupBy("vec").agg(some.alias("ids"))
    return whole.select(F.struct(F.element_at("ids", 1).alias("id"), F.xxhash64("vec").alias("h")).alias("node"), "vec", "ids")


def build(nodes: DataFrame, k: int = 40, reverse: int = 40, width: int = 6, trees: int = 3, still: float = 0.1, rounds: int = 10, seed: int = 11, cell: int = CELL, leaf: int = LEAF) -> dict:
    """The graph of a table (node, vec): tables `codes` (node, n, cell, code) and `lists` (n, c), where c are the
    `k` nearest found and up to `reverse` nodes, drawn by hash, that have n as theirs; and the rounds it took.
    To begin with, a node's nearest are those in its leaves in `trees` orders: random projections and, last, a random
    order, without which leaves could be worlds of their own. Rounds end when at most the share `still` of the entries is fresh."""
    first = nodes.select(F.size("vec")).head()
    dim = first[0] if first else 1
    mean = _mean(nodes, dim)
    codes = stored(_placed(_encoded(nodes, dim, mean, seed), "n").withColumn("cell", _cell(F.col("n"), cell)), "ann-codes")
    total = codes.count()
    lists = None
    for t in range(trees):
        placed = codes.withColumn("leaf", F.floor(F.col("n") / leaf))
        if t:
            again = codes.select(F.col("n").alias("node"), "code")
            if t == trees - 1:
                own = _placed(again.withColumn("__sign", F.xxhash64("node", F.lit(seed))).withColumn("__along", F.lit(0.0)), "at")
            else:
                own = _placed(_encoded(again, dim, mean, seed + t), "at")
            placed = own.select(F.col("node").alias("n"), "code", F.floor(F.col("at") / leaf).alias("leaf"))
        found = placed.groupBy("leaf").applyInArrow(_leaf(k, cell), FOUND)
        before = lists if lists is not None else codes.sparkSession.createDataFrame([], GRAPH)
        lists = stored(before.select("cell", "n", "c", "s").groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(_take(k, cell), GRAPH), "ann-lists")
    lists = lists.withColumn("fresh", F.transform("c", lambda _: F.lit(True)))
    took = 0
    while took < rounds and total > 1:
        took += 1
        members = _with_reverse(lists, reverse, took)
        # a list without a fresh entry has no pair to bring together
        members = members.where(F.exists("fresh", lambda x: x))
        named = members.select(F.col("cell").alias("by"), F.explode("c").alias("n"))
        asked = named.groupBy(_cell(F.col("n"), cell).alias("cell"), F.col("by")).agg(F.collect_set("n").alias("n"))
        known = codes.select("n", "code").join(lists.select("n", "least"), "n", "left").select(_cell(F.col("n"), cell).alias("cell"), "n", "code", F.coalesce("least", F.lit(-1.5).cast("float")).alias("least"))
        served = asked.groupBy("cell").cogroup(known.groupBy("cell")).applyInArrow(_serve, SERVED)
        found = members.groupBy("cell").cogroup(served.groupBy("cell")).applyInArrow(_meet(width, cell), FOUND)
        lists = stored(lists.select("cell", "n", "c", "s").groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(_take(k, cell), GRAPH), "ann-lists")
        fresh = lists.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("c"))).first()
        if (fresh[0] or 0) <= still * (fresh[1] or 1):
            break
    both = _with_reverse(lists, reverse, 0).select("n", F.array_distinct("c").alias("c"))
    return {"codes": codes, "lists": stored(both, "ann-graph"), "rounds": took, "dim": dim, "cell": cell}


def _with_reverse(lists: DataFrame, reverse: int, salt: int) -> DataFrame:
    """Each node's list with up to `reverse` of the nodes that name it: one of each of so many hash slots,
    so that a node named by very many is summed where they are."""
    edges = lists.select(F.col("n").alias("c"), F.posexplode("c").alias("i", "n"), "fresh").select("n", "c", F.element_at("fresh", F.col("i") + 1).alias("fresh"))
    h = F.xxhash64("n", "c", F.lit(salt))
    slots = edges.groupBy("n", F.pmod(h, F.lit(reverse)).alias("slot")).agg(F.min(F.struct(F.xxhash64(h).alias("h"), "c", "fresh")).alias("x"))
    back = slots.groupBy("n").agg(F.collect_list("x.c").alias("bc"), F.collect_list("x.fresh").alias("bf"))
    none = F.array().cast
    return lists.join(back, "n", "left").select(
        "cell", "n", F.concat("c", F.coalesce("bc", none("array<bigint>"))).alias("c"), F.concat("fresh", F.coalesce("bf", none("array<boolean>"))).alias("fresh")
    )


def _open(width: int):
    """Scores of a cell's nodes for the queries that ask for them: a query's `width` nearest that are nearer than its farthest."""

    def run(asked: pa.Table, codes: pa.Table) -> pa.Table:
        q, found = asked["q"].to_numpy(), []
        if len(q) and codes.num_rows:
            ids = codes["n"].to_numpy()
            order = np.argsort(ids)
            ids, m, queries, least = ids[order], _matrix(codes["code"])[order], _matrix(asked["code"]), asked["least"].to_numpy()
            row, c = _flat(asked["c"])
            at = np.searchsorted(ids, c)
            ends = np.searchsorted(row, np.arange(len(q) + 1))
            for i in range(len(q)):
                own = at[ends[i] : ends[i + 1]]
                s = m[own] @ queries[i]
                near = np.nonzero(s > least[i])[0]
                if len(near) > width:
                    near = near[np.argpartition(-s[near], width - 1)[:width]]
                if len(near):
                    found.append((q[i], ids[own[near]], s[near]))
        sizes = np.array([len(x[1]) for x in found], np.int64)
        return pa.table(
            {
                "q": pa.array([x[0] for x in found], pa.int64()),
                "c": _lists(sizes, np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64), pa.int64()),
                "s": _lists(sizes, np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.float32), pa.float32()),
            }
        )

    return run


def search(graph: dict, queries: DataFrame, beam: int = 128) -> DataFrame:
    """Greedy search for queries (q long, code binary, n): n is the node at which a query starts, or null, and
    then it starts at the nearest of the graph's entries. Returns (q, nodes array<struct<s, n>>): its beam,
    nearest first. A round opens all nodes of the beams that are not open and scores what they name; a query
    whose beam is open is done."""
    codes, lists = graph["codes"], graph["lists"]
    total = codes.count()
    entries = codes.where(F.pmod("n", F.lit(max(1, total // ENTRIES))) == 0).select("n", "code").limit(2 * ENTRIES).toArrow()  # at most two times ENTRIES rows
    e_n, e_m = entries["n"].to_numpy(), _matrix(entries["code"])

    def enter(batches):
        for b in batches:
            s = _matrix(b["code"]) @ e_m.T if len(e_n) else np.zeros((b.num_rows, 0), np.float32)
            near = np.argsort(-s, axis=1, kind="stable")[:, :8]
            own = b["n"].to_pylist()
            starts = [[*([{"s": 1.5, "n": o, "done": False}] if o is not None else []), *({"s": float(s[i, j]), "n": int(e_n[j]), "done": False} for j in near[i] if e_n[j] != o)] for i, o in enumerate(own)]
            yield pa.RecordBatch.from_arrays([b["q"], b["code"].cast(pa.binary()), pa.array(starts, STARTS)], ["q", "code", "nodes"])

    state = stored(queries.select("q", "code", "n").mapInArrow(tidy(enter), "q long, code binary, nodes array<struct<s:float,n:bigint,done:boolean>>"), "ann-beam")
    while True:
        front = state.select("q", F.explode(F.filter("nodes", lambda x: ~x.done)).alias("x")).select("q", F.col("x.n").alias("n"))
        size = front.count()
        if not size:
            return state.select("q", F.transform("nodes", lambda x: F.struct(x.s.alias("s"), x.n.alias("n"))).alias("nodes"))
        named = lists.join(broadcast_if(front, size, BROADCAST_FRONTIER), "n").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("c"))
        rest = F.expr("array_except(c, transform(nodes, x -> x.n))")
        least = F.when(F.size("nodes") < beam, F.lit(-1.5).cast("float")).otherwise(F.element_at("nodes", -1).getField("s"))
        asked = named.join(state, "q").select("q", "code", least.alias("least"), F.explode(rest).alias("c"))
        asked = asked.groupBy("q", _cell(F.col("c"), graph["cell"]).alias("cell")).agg(F.collect_list("c").alias("c"), F.first("code").alias("code"), F.first("least").alias("least"))
        found = asked.groupBy("cell").cogroup(codes.select("cell", "n", "code").groupBy("cell")).applyInArrow(_open(beam), "q long, c array<bigint>, s array<float>")
        news = F.transform(F.arrays_zip("s", "c"), lambda x: F.struct(x.s.alias("s"), x.c.alias("n"), F.lit(False).alias("done")))
        found = found.groupBy("q").agg(F.flatten(F.collect_list(news)).alias("news"))
        opened = F.transform("nodes", lambda x: F.struct(x.s.alias("s"), x.n.alias("n"), F.lit(True).alias("done")))
        every = F.concat(opened, F.coalesce("news", F.array().cast("array<struct<s:float,n:bigint,done:boolean>>")))
        state = stored(state.join(found, "q", "left").select("q", "code", F.slice(F.sort_array(every, False), 1, beam).alias("nodes")), "ann-beam")


STARTS = pa.list_(pa.struct([("s", pa.float32()), ("n", pa.int64()), ("done", pa.bool_())]))


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def neighbours(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = 128, exact: int = 48, **how) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row that `queries`, a condition on
    the id column, names. The `exact` nearest of a beam are scored on the original vectors."""
    nodes = stored(classes(vectors, id_col, vec_col, k + 1), "ann-nodes")
    graph = build(nodes.select("node", "vec"), **how)
    codes = graph["codes"].select("node", "n", "code")
    # the rows asked for, and their nodes: the same vector is searched once
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias("vec")).where(queries)
    rows = rows.where(F.col(id_col).isNotNull()).where(_usable(F.col("vec"))).where(F.size("vec") == graph["dim"])
    asked = rows.groupBy("vec", F.col(id_col).alias("query_id")).agg(F.count(F.lit(1)).alias("times"))
    wanted = stored(asked.join(nodes.select("node", "vec"), "vec").select("query_id", "times", "node"), "ann-asked")
    per = wanted.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"))
    starts = codes.join(per.select("node"), "node", "left_semi").select(F.col("n").alias("q"), "code", "n")
    found = search(graph, starts, beam).select("q", F.explode(F.slice("nodes", 1, exact)).alias("x")).select("q", F.col("x.n").alias("n"))
    near = codes.select("n", "node").join(nodes, "node").select("n", F.col("node").alias("other"), "ids", F.col("vec").alias("there"))
    own = codes.select(F.col("n").alias("q"), "node").join(nodes, "node").join(per, "node").select("q", "node", "n_rows", F.col("vec").alias("here"))
    scored = found.join(near, "n").join(own, "q")
    scored = scored.select("node", "n_rows", F.when(F.col("node") == F.col("other"), True).otherwise(False).alias("own"), _cosine(F.col("here"), F.col("there")).alias("score"), F.posexplode("ids").alias("i", "vec_id"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "own", "i"))), 1, k + 1)
    results = scored.groupBy("node", "n_rows").agg(best.alias("best"))
    each = join_counted(wanted, results, ["node"], "n_rows")
    # the query's own row is one of its node's rows with its id; those with smaller ids stay before it
    mine = F.array_position(F.transform("best", lambda x: x.own & (x.vec_id == F.col("query_id"))), True)
    others = F.when(mine > 0, F.concat(F.slice("best", 1, F.greatest(mine.cast("int") - 1, F.lit(0))), F.slice("best", mine.cast("int") + 1, k + 1))).otherwise(F.col("best"))
    out = each.select("query_id", "times", F.slice(others, 1, k).alias("best")).select("query_id", "times", F.posexplode("best").alias("i", "x"))
    out = out.select("query_id", (F.col("i") + 1).alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("t"))
    return out.drop("t")

