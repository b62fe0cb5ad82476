"""Removal of repeated byte strings by bucket-pointer refinement.

Every string of `length` bytes holds an anchor: the q-gram of least hash among those that start in
it. Equal strings have the same anchor at the same place, so the anchors' q-gram hashes are the
initial buckets; anchors alone in theirs are dropped before any text is moved. The others come
together with the bytes around them, and all strings through them are refined in the manner of
bucket-pointer refinement: buckets of short grams are sorted by the buckets at later offsets, and
the buckets found serve, doubled, as the pointers of the next round. A string that is alone in its
bucket takes no part in later rounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ._work import broadcast_if, stored, tidy

SEGMENT = 1 << 20
#: Distinct surroundings of one anchor that are refined in a task; those of an anchor with more go,
#: string by string, through an aggregate over all tasks. Also the size of a refinement's batch.
WIDE = 8192
#: So many ids of whole copies, digests of texts that have copies, or removed runs are broadcast at most.
BROADCAST_COPIES, BROADCAST_FIRSTS, BROADCAST_RUNS = 1_000_000, 300_000, 250_000

_BYTE = np.random.default_rng(2011).integers(0, 1 << 64, 256, np.uint64)  # any table of random words serves
_BASE = 0x9E3779B97F4A7C15
TOLD = -(1 << 63)  # no document has this number


@dataclass(frozen=True)
class Shape:
    """length: bytes of a repeated string; q: bytes of an anchor."""

    length: int = 100
    q: int = 40

    @property
    def reach(self) -> int:
        """Bytes that a string through an anchor can start before it."""
        return self.length - self.q


def _gram_hashes(b: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams, by doubling."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    h, have, left, parts = _BYTE[b], 1, q, []
    while left:
        if left & 1:
            parts.append((have, h))
        left >>= 1
        if left:
            h = h[: len(h) - have] * power(have) + h[have:]
            have *= 2
    n, out, at = len(b) - q + 1, None, 0
    for width, part in reversed(parts):
        own = part[at : at + n]
        out = own if out is None else out * power(width) + own
        at += width
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _slide(x: np.ndarray, window: int, best) -> np.ndarray:
    """best over every `window` neighbours."""
    have = 1
    while 2 * have <= window:
        x = best(x[: len(x) - have], x[have:])
        have *= 2
    rest = window - have
    return best(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(text: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors; none in a text shorter than a string."""
    n, all_at, all_h = len(text), [], []
    starts = shape.reach + 1
    if n < shape.length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    for s in range(0, n, SEGMENT):
        low = max(0, s - shape.reach)
        b = np.frombuffer(text, np.uint8)[low : min(n, s + SEGMENT + shape.length)]
        if len(b) < shape.length:
            break
        h = _gram_hashes(b, shape.q)
        least = _slide(h, starts, np.minimum)  # of the strings that start here
        padded = np.concatenate([np.zeros(starts - 1, np.uint64), least, np.zeros(starts - 1, np.uint64)])
        at = np.flatnonzero(_slide(padded, starts, np.maximum)[: len(h)] == h) + low
        at = at[(at >= s) & (at < s + SEGMENT)]
        all_at.append(at)
        all_h.append(h[at - low])
    return np.concatenate(all_at), np.concatenate(all_h)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and how often each number occurs."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number, count


def _maybe_equal(rows: np.ndarray, alive: np.ndarray, shape: Shape) -> np.ndarray:
    """Which of the strings that are alive share their hash with another: equal strings always do, so
    the rest need no refinement."""
    width = rows.shape[1]
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(width, _BASE, np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(width, pow(_BASE, -1, 1 << 64), np.uint64)]))
    sums = np.zeros((len(rows), width + 1), np.uint64)
    np.cumsum(_BYTE[rows] * power[:width], axis=1, out=sums[:, 1:])
    n = shape.reach + 1
    hashes = ((sums[:, shape.length : shape.length + n] - sums[:, :n]) * inverse[:n])[alive]
    number, _ = pd.factorize(hashes)
    out = np.zeros(alive.shape, bool)
    out[alive] = np.bincount(number)[number] > 1 if len(number) else False
    return out


def refine(rows: np.ndarray, first: np.ndarray, last: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the equal strings in rows of bytes, an anchor at column `reach` of each.

    Bytes of row r are rows[r, first[r]:last[r]]. Returns row, column and bucket of every string
    that has an equal. Exact: a bucket's number stands for its bytes, not for a hash of them.
    """
    m, width = rows.shape
    column = np.arange(shape.reach + 1)
    alive = (column >= first[:, None]) & (column + shape.length <= last[:, None])
    alive &= _maybe_equal(rows, alive, shape)
    grams = rows.astype(np.uint64)
    size = 1
    while size < 8:
        grams = grams[:, : grams.shape[1] - size] | (grams[:, size:] << np.uint64(8 * size))
        size *= 2
    sizes = [size]
    while sizes[-1] < shape.length:
        sizes.append(min(2 * sizes[-1], shape.length))
    offsets = [np.zeros(1, np.int64)]  # of the grams, of each size, whose buckets a string's bucket rests on
    for small, large in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
        offsets.append(np.union1d(offsets[-1], offsets[-1] + large - small))
    at_row, at_col = np.nonzero(alive)
    pointer, before = None, 0
    for size, places in zip(sizes, offsets[::-1], strict=True):
        if not len(at_row):
            break
        need = np.zeros((m, width), bool)
        for o in places:
            need[at_row, at_col + o] = True
        r, c = np.nonzero(need)
        if pointer is None:
            number, count = _numbered(grams[r, c])
        else:
            number, count = _numbered(pointer[r, c] * np.int64(pointer.max() + 1) + pointer[r, c + size - before])
        pointer, before = np.full((m, width), -1, np.int64), size
        pointer[r, c] = number
        ok = np.ones(len(at_row), bool)
        for o in places:
            ok &= count[pointer[at_row, at_col + o]] > 1
        at_row, at_col = at_row[ok], at_col[ok]
    return at_row, at_col, pointer[at_row, at_col] if len(at_row) else np.empty(0, np.int64)


def _repeated(rid: np.ndarray, pos: np.ndarray, left: np.ndarray, around: list[bytes], shape: Shape):
    """(rid, start, end) of the strings through anchors that also start earlier: a run an anchor."""
    width = shape.reach + shape.length
    rows = np.zeros((len(around), width), np.uint8)
    first = shape.reach - left
    last = first + np.fromiter(map(len, around), np.int64, len(around))
    for k, c in enumerate(around):
        rows[k, first[k] : last[k]] = np.frombuffer(c, np.uint8)
    row, col, bucket = refine(rows, first, last, shape)
    if not len(row):
        return [np.empty(0, np.int64)] * 3
    start = pos[row] - shape.reach + col
    order = np.lexsort((start, rid[row]))
    new = np.concatenate(([True], (rid[row][order][1:] != rid[row][order][:-1]) | (start[order][1:] != start[order][:-1])))
    rank = np.empty(len(row), np.int64)
    rank[order] = np.cumsum(new)
    least = np.full(bucket.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, rank)
    again = rank > least[bucket]
    row, start = row[again], start[again]
    if not len(row):
        return [np.empty(0, np.int64)] * 3
    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))  # rows come in order
    return rid[row[edge]], np.minimum.reduceat(start, edge), np.maximum.reduceat(start, edge) + shape.length


def _spread(h: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> list[pa.Array]:
    """(known, h, rid, pos) of a batch's anchors: those whose h the batch holds twice are known not to be
    alone and may go anywhere; one row of rid TOLD tells the others of their h."""
    _, number, count = np.unique(h, return_inverse=True, return_counts=True)
    known = count[number] > 1
    told = np.unique(h[known])
    return [
        pa.array(np.concatenate([known, np.zeros(len(told), bool)])),
        pa.array(np.concatenate([h, told]).view(np.int64)),
        pa.array(np.concatenate([rid, np.full(len(told), TOLD)])),
        pa.array(np.concatenate([pos, np.zeros(len(told), np.int64)]).astype(np.int32)),
    ]


def _live(batches):
    """Of rows (known, h, rid, pos), sorted by h, those known or whose h is not alone; holds one batch and
    one row."""
    for t in _not_alone(batches):
        t = t.filter(pc.not_equal(t.column("rid"), TOLD))
        yield pa.RecordBatch.from_arrays([t.column(c) for c in ("h", "rid", "pos")], ["h", "rid", "pos"])


def _not_alone(batches):
    held, shared = None, False  # the last row seen, and whether its h was seen before it
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([held, b]) if held is not None else pa.Table.from_batches([b])
        h = t.column("h").to_numpy()
        same = h[1:] == h[:-1]
        keep = np.zeros(len(h), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= shared
        keep |= t.column("known").to_numpy(zero_copy_only=False)
        held, shared = t.slice(len(h) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
        keep[-1] = False
        yield from t.filter(pa.array(keep)).combine_chunks().to_batches()
    if held is not None and shared:
        yield held


_FOUND = "rid long, s long, e long, pos long, left long, around binary"


def _grouped(shape: Shape, wide: int):
    """Goes through anchors with their surroundings, sorted by (h, left, around, rid, pos)."""

    def run(batches):
        waiting: list[tuple] = []  # first occurrences: (rid, pos, left, around) of closed buckets
        bucket: list[tuple] = []  # of the bucket in hand
        overflow, key, before = False, None, None

        def found(rid, s, e):
            n = pa.nulls(len(rid), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(s), pa.array(e), n, n, pa.nulls(len(rid), pa.binary())], names)

        def passed_on(rows):
            rid, pos, left, around = zip(*rows, strict=True)
            n = pa.nulls(len(rid), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rid), n, n, pa.array(pos), pa.array(left), pa.array(around, pa.binary())], names)

        def refined():
            rid, pos, left, around = zip(*waiting, strict=True)
            waiting.clear()
            return found(*_repeated(np.array(rid), np.array(pos), np.array(left), list(around), shape))

        names = [c.split()[0] for c in _FOUND.split(", ")]
        for b in batches:
            done = b.filter(pc.is_null(b.column("around")))
            if done.num_rows:
                yield found(*(done.column(c).to_numpy() for c in ("rid", "pos", "left")))
            b = b.filter(pc.is_valid(b.column("around")))
            n = b.num_rows
            if not n:
                continue
            h, rid, pos, left = (b.column(c).to_numpy() for c in ("h", "rid", "pos", "left"))
            around = b.column("around")
            same = np.zeros(n, bool)  # as the row before
            same[1:] = (h[1:] == h[:-1]) & (left[1:] == left[:-1]) & pc.equal(around[1:], around[:-1]).to_numpy(zero_copy_only=False)
            if before is not None:
                same[0] = before[:3] == (h[0], left[0], around[0].as_py())
            # the first occurrence of each row's surroundings
            lead = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
            head_rid = np.where(lead >= 0, rid[lead], before[3] if before else 0)
            head_pos = np.where(lead >= 0, pos[lead], before[4] if before else 0)
            again = same & ((rid != head_rid) | (pos != head_pos))
            size = pc.binary_length(around).to_numpy()
            again &= size >= shape.length
            if again.any():
                s = pos[again] - left[again]
                yield found(rid[again], s, s + size[again])
            for i in np.flatnonzero(~same).tolist():
                if h[i] != key:
                    if overflow:
                        if bucket:
                            yield passed_on(bucket)
                    elif len(bucket) > 1:
                        if waiting and len(waiting) + len(bucket) > wide:
                            yield refined()
                        waiting += bucket
                    key, bucket, overflow = h[i], [], False
                bucket.append((rid[i], pos[i], left[i], around[i].as_py()))
                if len(bucket) > wide:
                    yield passed_on(bucket)
                    bucket, overflow = [], True
            before = (h[-1], left[-1], around[n - 1].as_py(), head_rid[-1], head_pos[-1])
        if overflow and bucket:
            yield passed_on(bucket)
        elif len(bucket) > 1 and not overflow:
            if waiting and len(waiting) + len(bucket) > wide:
                yield refined()
            waiting += bucket
        if waiting:
            yield refined()

    return run


def _strings(shape: Shape):
    """(key, rid, start) of every string through an anchor: the way of anchors with very many
    different surroundings."""

    def run(batches):
        for b in batches:
            keys, rids, starts = [], [], []
            for rid, pos, left, around in zip(*(b.column(c).to_pylist() for c in ("rid", "pos", "left", "around")), strict=True):
                for t in range(0, min(left, len(around) - shape.length) + 1):
                    keys.append(md5(around[t : t + shape.length]).digest())
                    rids.append(rid)
                    starts.append(pos - left + t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rids, pa.int64()), pa.array(starts, pa.int64())], ["key", "rid", "start"])

    return run


def runs(rows: DataFrame, shape: Shape, wide: int = WIDE) -> DataFrame:
    """(rid, s, e): runs of repeated bytes of rows (rid, t), which may overlap. rid is a long in the
    order in which documents count as earlier; rows of one rid have the same text."""

    def anchored(batches):
        for b in batches:
            rid, at, h = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for r, t in zip(b.column("rid").to_numpy(), b.column("t").to_pylist(), strict=True):
                a, x = anchors(t, shape)
                rid.append(np.full(len(a), r))
                at.append(a)
                h.append(x)
            yield pa.RecordBatch.from_arrays(_spread(np.concatenate(h), np.concatenate(rid), np.concatenate(at)), ["known", "h", "rid", "pos"])

    every = rows.mapInArrow(tidy(anchored), "known boolean, h long, rid long, pos int")
    every = every.repartition(F.when(F.col("known"), F.xxhash64("rid", "pos")).otherwise(F.col("h"))).sortWithinPartitions("h")
    live = stored(every.mapInArrow(tidy(_live), "h long, rid long, pos int"), "anchors")
    lists = live.groupBy("rid").agg(F.collect_set(F.struct("pos", "h")).alias("at"))

    def surrounded(batches):
        """What surrounds each anchor. Within a batch only the first of equal surroundings goes on; of the
        others it is known already that they start earlier as well: they go as (start, end), around null."""
        for b in batches:
            out, seen = [[], [], [], [], []], {}
            order = np.argsort(b.column("rid").to_numpy(), kind="stable").tolist()
            rid, text, at = (b.column(c).to_pylist() for c in ("rid", "t", "at"))
            for k in order:
                r, t = rid[k], text[k]
                for p, h in sorted((a["pos"], a["h"]) for a in at[k]):
                    low = max(0, p - shape.reach)
                    x = t[low : p + shape.length]
                    first = seen.setdefault((p - low, x), (r, p, k))
                    if first == (r, p, k):
                        row = (h, r, p, p - low, x)
                    elif first[:2] != (r, p) and len(x) >= shape.length:
                        row = ((h ^ (r * 1_000_003 + p) * _BASE) & ((1 << 63) - 1), r, low, low + len(x), None)
                    else:
                        continue
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["h", "rid", "pos", "left", "around"])
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["h", "rid", "pos", "left", "around"])

    around = rows.join(lists, "rid").select("rid", "t", "at").mapInArrow(tidy(surrounded), "h long, rid long, pos long, left long, around binary")
    around = around.repartition("h").sortWithinPartitions("h", "left", "around", "rid", "pos")
    found = stored(around.mapInArrow(tidy(_grouped(shape, wide)), _FOUND), "runs")
    out = found.where("around is null").select("rid", "s", "e")
    passed = found.where("around is not null").select("rid", "pos", "left", "around")
    if not passed.isEmpty():
        strings = passed.mapInArrow(tidy(_strings(shape)), "key binary, rid long, start long")
        least = strings.groupBy("key").agg(F.min(F.struct("rid", "start")).alias("least"))
        more = strings.join(least, "key").where(F.struct("rid", "start") > F.col("least"))
        out = out.unionByName(more.select("rid", F.col("start").alias("s"), (F.col("start") + shape.length).alias("e")))
    return out


def _cut(names: list[str], length: int):
    names = [*names, "kept_bytes", "n_bytes", "n_removed", "n_spans"]

    def run(batches):
        for b in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, copy, found in zip(*(b.column(b.num_columns - k).to_pylist() for k in (3, 2, 1)), strict=True):
                text = text or b""
                n = len(text)
                if copy:
                    found = [{"s": 0, "e": n}] if n >= length else None
                out, at, gone, count, end = [], 0, 0, 0, -1
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if s > end:
                        out.append(text[at:s])
                        count += 1
                        gone += e - s
                        end = e
                    elif e > end:
                        gone += e - end
                        end = e
                    at = end
                out.append(text[at:])
                kept.append(b"".join(out))
                sizes.append(n)
                removed.append(gone)
                spans.append(count)
            made = [pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *made], names)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, q: int = 40, wide: int = WIDE) -> DataFrame:
    """docs with kept_bytes (binary: a cut may split a character), n_bytes, n_removed and n_spans.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a row with a
    smaller id, or at a smaller offset of the same text. Strings are judged on the input and never
    cross texts. A null text is empty. Null ids come last. Rows that share id and text are one
    document and get the same result; rows that share an id only are ordered by a hash of the text.
    Input columns named like a result are replaced; an empty table gives an empty table.
    """
    shape = Shape(length, q)
    results = ["kept_bytes", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*results)
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = stored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.unhex(F.md5(text)).alias("md5"), F.octet_length(text).alias("n")), "text-facts")
    ids = facts.agg(F.count_distinct("id", "digest"), F.count_distinct("id"), F.count_distinct(F.when(F.col("id").isNull(), F.col("digest")))).first()
    plain = isinstance(docs.schema[id_col].dataType, (LongType, IntegerType, ShortType, ByteType)) and ids[0] == ids[1] and ids[2] <= 1
    if plain:  # the id itself says which comes first
        numbered = facts.withColumn("rid", F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)))
        source = docs.withColumn("__rid", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)))
    else:
        order = [F.col("id").asc_nulls_last(), F.col("digest")]
        table = facts.select("id", "digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
        table = stored(table.withColumn("rid", F.monotonically_increasing_id()), "text-order")
        both = lambda a, b: a["id"].eqNullSafe(b["__id"]) & (a["digest"] == b["__digest"])
        right = table.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("rid").alias("__rid"))
        numbered = facts.join(right, both(facts, right)).withColumnRenamed("__rid", "rid")
        source = docs.withColumn("__own", F.xxhash64(text))
        source = source.join(right, source[id_col].eqNullSafe(right["__id"]) & (source["__own"] == right["__digest"])).drop("__own", "__id", "__digest")
    firsts = numbered.where(F.col("n") >= length).groupBy("md5", "n").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last")
    firsts = stored(firsts, "first-copies")
    copies = numbered.join(broadcast_if(firsts, firsts.count(), BROADCAST_FIRSTS), ["md5", "n"]).where("rid > first").select(F.col("rid").alias("__copy")).distinct()
    copies = stored(copies, "copies")
    copies = broadcast_if(copies, copies.count(), BROADCAST_COPIES)
    body = source.select(F.col("__rid").alias("rid"), text.cast("binary").alias("t")).where(F.length("t") >= length)
    found = runs(body.join(copies, F.col("rid") == F.col("__copy"), "left_anti"), shape, wide)
    lists = stored(found.groupBy(F.col("rid").alias("__run_rid")).agg(F.collect_list(F.struct("s", "e")).alias("__runs")), "run-lists")
    lists = broadcast_if(lists, (lists.agg(F.sum(F.size("__runs"))).first()[0] or 0), BROADCAST_RUNS)
    marked = source.join(copies, F.col("__rid") == F.col("__copy"), "left").join(lists, F.col("__rid") == F.col("__run_rid"), "left")
    marked = marked.select(*names, text.cast("binary").alias("__text_bytes"), F.col("__copy").isNotNull().alias("__is_copy"), "__runs")
    wide_schema = docs.select("*", F.lit(b"").alias("kept_bytes"), *(F.lit(0).cast("long").alias(c) for c in results[1:])).schema
    return marked.mapInArrow(tidy(_cut(names, length)), wide_schema)
