"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into `blocks` blocks. Two fingerprints that differ in at most
`distance` bits agree on at least `blocks - distance` blocks, so each is filed once for every
choice of that many blocks; fingerprints filed together are verified by their Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import broadcast_if, join_counted, stored, tidy
from .links import components

#: Fingerprints that one bucket may hold to be compared in its task: up to there all pairs cost
#: no more than the 2,081 points of the other way. Beyond, that way is taken; no link is lost.
BUCKET_PAIRS = 4096
#: So many ids of dropped rows are broadcast at most (some 50 MB); more are joined by shuffle.
BROADCAST_GONE = 1_000_000


def shingle_hashes(text: bytes, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of the ASCII-lower-cased words of a UTF-8 text, repeats included; of the
    whole sequence where it has fewer words than a shingle, and none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    xxh = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([xxh(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
    return np.fromiter((xxh(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The unsigned number whose bits are set in over half the hashes; 0 for none."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.empty(64, np.int64)
    for j in range(8):  # little endian: byte j holds bits 8j to 8j+7
        bits[8 * j : 8 * j + 8] = np.bincount(columns[:, j], minlength=256) @ BITS
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned SimHash of a UTF-8 text."""
    return majority(shingle_hashes(text, shingle, seed))


#: BITS[v, i] is bit i of the byte v.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, digest, fp): a hash of the text, and its fingerprint as a signed long. Null and empty
    texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t or b"", shingle) for t in batch.column("t").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(values.view(np.int64))], ["doc_id", "digest", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, digest long, fp long")


def _within(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links of the components of one bucket."""
    near = np.empty((len(values), len(values)), bool)
    for k in range(0, len(values), 256):  # a strip at a time: only the verdicts of all pairs are held
        near[k : k + 256] = np.bitwise_count(values[k : k + 256, None] ^ values[None, :]) <= distance
    left, out = np.ones(len(values), bool), []
    for i in range(len(values)):
        if not left[i]:
            continue
        left[i] = False
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & left)
            left[front] = False
            out += [(i, int(j)) for j in front]
    return out


def _filed(distance: int, most: int):
    """Goes through rows sorted by key and gives spanning links (a, b) of each key's fingerprints;
    for a key of more than `most` fingerprints each one as (a, null). Holds at most one key's
    fingerprints up to `most`."""

    def run(batches):
        held: list[np.ndarray] = []
        key, n = None, 0

        def closed(a, b):
            if key is not None and 1 < n <= most:
                v = np.unique(np.concatenate(held).view(np.uint64))
                for i, j in _within(v, distance):
                    a.append(v[i])
                    b.append(v[j])

        def batch_of(a, b, hot):
            a = np.array(a, np.uint64).view(np.int64)
            b = np.array(b, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, hot])), pa.concat_arrays([pa.array(b), pa.nulls(len(hot), pa.int64())])], ["a", "b"]
            )

        none = np.empty(0, np.int64)
        for batch in batches:
            pos, mask, fp = (batch.column(c).to_numpy() for c in ("pos", "mask", "fp"))
            if not len(fp):
                continue
            a, b, hot = [], [], [none]
            cut = np.flatnonzero((pos[1:] != pos[:-1]) | (mask[1:] != mask[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            pairs = np.flatnonzero(ends - starts == 2)
            pairs = pairs[(pairs > 0) & (pairs < len(starts) - 1)]  # whole keys of two, all at once
            x, y = fp[starts[pairs]].view(np.uint64), fp[starts[pairs] + 1].view(np.uint64)
            near = (np.bitwise_count(x ^ y) <= distance) & (x != y)
            a.extend(x[near])
            b.extend(y[near])
            rest = np.flatnonzero(ends - starts > 2)
            rest = np.union1d(rest, [0, len(starts) - 1])
            for g in rest.tolist():
                s, e = starts[g], ends[g]
                this = (pos[s], mask[s])
                if this != key:
                    closed(a, b)
                    key, n, held = this, 0, []
                part = fp[s:e]
                n += len(part)
                if n > most:
                    hot += held + [part]
                    held = []
                else:
                    held.append(part)
            yield batch_of(a, b, np.concatenate(hot))
        a, b = [], []
        closed(a, b)
        yield batch_of(a, b, none)

    return run


def _ball(radius: int, strip: int = 1 << 16) -> Iterator[np.ndarray]:
    """The numbers of 64 bits with at most `radius` bits set, in arrays of `strip` at most."""
    masks = (sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r))
    while part := list(islice(masks, strip)):
        yield np.array(part, np.uint64)


def _around(radius: int):
    """(fp, point) of all points within `radius` of each fingerprint; a task holds a strip of them."""

    def run(batches):
        for b in batches:
            fps = b.column("fp").to_numpy().view(np.uint64)
            for masks in _ball(radius):
                few = max(1, (1 << 16) // len(masks))
                for k in range(0, len(fps), few):
                    own = fps[k : k + few]
                    points = (own[:, None] ^ masks[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(masks)).view(np.int64)), pa.array(points.view(np.int64))], ["fp", "point"])

    return run


def hamming_links(fps: DataFrame, *, distance: int = 4, blocks: int = 8, most: int = BUCKET_PAIRS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp that leave their components
    under "at most `distance` bits differ" as they are. Buckets of more than `most` fingerprints go
    the other way: further blocks would not split a ball of near fingerprints, but two that differ
    in at most r + s bits, and no others, have a point within r of the one and s of the other, so
    they are linked through the points around them, in linear space."""
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        m = sum(1 << i for i in range(64) if i * blocks // 64 in chosen)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    filed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("pos", "mask"))
    filed = filed.repartition("pos", "mask").sortWithinPartitions("pos", "mask")
    found = stored(filed.mapInArrow(tidy(_filed(distance, most)), "a long, b long").distinct(), "links")
    links = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if not hot.isEmpty():
        links = links.unionByName(_through_points(hot, distance))
    return links


def _through_points(hot: DataFrame, distance: int) -> DataFrame:
    """Links of any number of fingerprints at most `distance` bits apart: each is filed at the points
    within half the distance, each point keeps the least of its fingerprints and links the rest to
    it; where the distance is odd, those one bit further out are linked to it too."""

    hot = stored(hot, "hot-fingerprints")
    at = lambda radius: hot.repartition(max(1, -(-hot.count() // 1024))).mapInArrow(tidy(_around(radius)), "fp long, point long")
    near, far = at(distance // 2), at(distance - distance // 2)
    least = near.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top"))
    least = least.where("b != top" if distance % 2 == 0 else "true").drop("top")
    return far.join(least, "point").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def near_groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 8
) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs.

    component_id is the least doc_id that can be reached over links of at most `distance` bits.
    Equal fingerprints are one node, however many rows share them. Null, empty and blank texts have
    fingerprint 0 and are linked like any other. Rows with the same id stay separate rows; null ids
    are never a component_id unless a component has no other. An empty table gives an empty table;
    columns other than id and text are not read.
    """
    marked = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    by_fp = _firsts(marked, F.col("doc_id"), distance, blocks)
    return join_counted(marked, by_fp, ["fp"], "rows").select("doc_id", "fp", F.col("first").alias("component_id"))


def _firsts(marked: DataFrame, key: Column, distance: int, blocks: int) -> DataFrame:
    """(fp, first, rows): the least key in the component of each distinct fingerprint, and its rows."""
    nodes = stored(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("rows")), "by-fingerprint")
    roots = components(hamming_links(nodes.select("fp"), distance=distance, blocks=blocks))
    linked = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    first = stored(linked.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("nodes")), "firsts")
    of_linked = join_counted(linked, first, ["root"], "nodes").select("fp", "first", "rows")
    of_lone = nodes.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("first"), "rows")
    return stored(of_linked.unionByName(of_lone), "components")


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, blocks: int = 8
) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the one with the least id stays,
    null ids last, among equal ids the one with the least text hash, and of rows that repeat an id
    and its text one. All columns stay as they are."""
    marked = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")
    return survivors(docs, join_counted(marked, _firsts(marked, key, distance, blocks), ["fp"], "rows"), id_col, text_col)


def survivors(docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that are the first of their group, of repeated ones one; named: (doc_id,
    digest, first) of every row."""
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest"))
    named = stored(named.select("doc_id", "digest", stays.alias("stays")), "survivors")
    gone = named.where("not stays").select(F.col("doc_id").alias("__gone_id"), F.col("digest").alias("__gone_digest")).distinct()
    counts = named.where("stays").agg(F.count(F.lit(1)), F.count_distinct(F.struct("doc_id", "digest"))).first()
    digest = F.xxhash64(text_col)
    left = docs.join(
        broadcast_if(gone, gone.count(), BROADCAST_GONE),
        docs[id_col].eqNullSafe(F.col("__gone_id")) & (digest == F.col("__gone_digest")),
        "left_anti",
    )
    if counts[0] == counts[1]:
        return left
    return left.withColumn("__digest", digest).dropDuplicates([id_col, "__digest"]).drop("__digest")
