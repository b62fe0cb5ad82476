"""Near copies by the cosine of their shingle sets, the similarity that SimHash estimates.

Blocks of a 64-bit fingerprint can promise a few differing bits only, and pairs at a similarity of
0.8 differ by up to 20. So the fingerprints' links come first and are verified on the shingles; what
lies further apart is found by bands: of `bands * rows` minima of the shingles' hashes, each taken
under a multiplier of its own, `rows` together make a key, and texts that share a key are verified
too. A pair of equally long texts at cosine 0.8 (Jaccard 2/3) shares none of 48 keys of 3 minima once
in 2e7 pairs, one at Jaccard 0.8 once in 1e15. Nothing but the lacking keys loses a link: each pair that
shares a key is verified unless both are in one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._work import HOT, broadcast_if, join_counted, stored, tidy
from .links import components

#: So many keys that two texts share, or ids of texts, are broadcast at most (some 50 MB); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A task that compares a key's texts with each other holds two chunks of so many bytes of shingles.
CHUNK_BYTES = 512 << 10
_M = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of a set of 64-bit hashes, one a band; none for an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    by = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _M).astype(np.uint32) | np.uint32(1)
    half, least = (found >> np.uint64(32)).astype(np.uint32), None
    for k in range(0, len(half), 2048):  # a strip at a time, however long the text
        m = (by[:, None] * half[None, k : k + 2048]).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    key = np.arange(bands, dtype=np.uint64)
    for m in least.astype(np.uint64).reshape(bands, rows).T:
        key = _mixed(key * _M + m)
    return key.view(np.int64)


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, h1, h2, n, fp, keys): the text's hash, its shingle set's hash and size, the
    fingerprint and the band keys."""

    def run(batches):
        for b in batches:
            heads, fps, keys = [], [], []
            for t in b.column("t").to_pylist():
                hashes = simhash.shingle_hashes(t or b"", shingle)
                found = np.unique(hashes)
                heads.append((*np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist(), len(found)))
                fps.append(simhash.majority(hashes))
                keys.append(band_keys(found, bands, rows))
            h1, h2, n = zip(*heads, strict=True) if heads else ((), (), ())
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *keys]))
            made = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), *made], ["doc_id", "digest", "h1", "h2", "n", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows_ = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("t"))
    return rows_.mapInArrow(tidy(run), f"doc_id {kind}, digest long, h1 long, h2 long, n long, fp long, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, found): the distinct shingle hashes of one text of each of nodes (node, doc_id, digest)."""

    def run(batches):
        for b in batches:
            found = [np.unique(simhash.shingle_hashes(t or b"", shingle)).view(np.int64) for t in b.column("t").to_pylist()]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in found]))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *found])))], ["node", "found"])

    n = nodes.count()
    right = broadcast_if(nodes.select("node", F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")), n, BROADCAST_ROWS)
    texts = docs.join(right, docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__digest")))
    made = stored(texts.select("node", docs[text_col].cast("binary").alias("t")).mapInArrow(tidy(run), "node long, found array<long>"), "shingle-sets")
    if made.count() == n:
        return made
    return stored(made.dropDuplicates(["node"]), "shingle-sets")  # rows that repeat an id and its text


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) whose sets have at least the similarity. A b with many partners is
    dealt out with its set, HOT partners a share."""
    shares = pairs.groupBy("b").agg(F.expr(f"1 + count(1) div {HOT}").alias("shares"))
    shares = stored(shares, "shares")
    right = sets.withColumnRenamed("node", "b").join(shares, "b").select(
        "b", F.col("found").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    )
    dealt = pairs.join(shares, "b").withColumn("share", F.expr("pmod(xxhash64(a), shares)")).drop("shares")
    both = dealt.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(right, ["b", "share"])
    shared = F.size(F.array_intersect("x", "y")).cast("double")
    product = F.size("x").cast("double") * F.size("y")
    return both.where(shared * shared >= F.lit(similarity * similarity - 1e-12) * product).select("a", "b")


def _rooted(rows: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    right = roots.select(F.col("node").alias(column), F.col("root").alias(out))
    return rows.join(right, column, "left").withColumn(out, F.coalesce(out, column))


def _compared(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between texts that share a key and are in different components, from rows (key, node,
    root, chunks). A key's texts are cut in chunks of CHUNK_BYTES and compared chunk by chunk, in as many
    tasks as there are pairs of chunks; a task joins components as it goes, so that texts known to
    belong together are not compared."""
    cut = rows.withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cut = cut.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "root")

    def compare(table):
        node, chunk = (table.column(c).to_numpy() for c in ("node", "chunk"))
        roots, part = np.unique(table.column("root").to_numpy(), return_inverse=True)
        part = part.copy()
        lists = table.column("found").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(size)
        a, b = [], []
        for k in range(len(node)):
            away = (part != part[k]) & (np.minimum(size, size[k]) >= similarity * similarity * np.maximum(size, size[k]) - 1e-9)
            if chunk.min() != chunk.max():
                away &= chunk != chunk[k]
            away[: k + 1] = False
            if not away.any():
                continue
            mark = np.zeros(ids.max() + 1, bool)
            mark[ids[ends[k] - size[k] : ends[k]]] = True
            shared = np.add.reduceat(mark[ids], ends - size).astype(np.float64)
            for m in np.flatnonzero(away & (shared * shared >= (similarity * similarity - 1e-12) * size * size[k])).tolist():
                if part[m] != part[k]:
                    a.append(node[k])
                    b.append(node[m])
                    part[part == part[m]] = part[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut.join(sets, "node").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, distance: int, blocks: int) -> DataFrame:
    """(node, root) of the nodes (node, n, fp, keys, least) that have a near copy."""
    at = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = stored(at.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "shared-keys")
    small = shared.count() <= BROADCAST_ROWS
    met = at.join(F.broadcast(shared.drop("rows")), "key") if small else join_counted(at, shared, ["key"], "rows").where("center is not null")
    met = stored(met.where("node != center").select("key", "node", "n", "center"), "met")

    by_fp = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("rows")), "by-fingerprint")
    equal = join_counted(nodes.select("fp", "node"), by_fp.where("rows > 1"), ["fp"], "rows").where("rep is not null and node != rep")
    near = simhash.hamming_links(by_fp.select("fp"), distance=distance, blocks=blocks)
    rep = lambda side: by_fp.select(F.col("fp").alias(side), F.col("rep").alias(f"r{side}"))
    near = near.join(rep("a"), "a").join(rep("b"), "b")
    first = met.groupBy("node").agg(F.min("center").alias("b")).withColumnRenamed("node", "a")
    first = first.unionByName(equal.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    first = first.unionByName(near.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")))
    first = stored(first.distinct(), "pairs")

    ids = met.select("node").union(met.select("center")).union(first.select("a")).union(first.select("b")).distinct()
    named = nodes.select("node", F.col("least.doc_id").alias("doc_id"), F.col("least.digest").alias("digest")).join(ids, "node", "left_semi")
    sets = _sets(docs, stored(named, "compared-nodes"), id_col, text_col, shingle)

    roots = components(stored(_verified(first, sets, similarity), "verified"))
    second = met.select(F.col("node").alias("a"), F.col("center").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = _rooted(_rooted(second, roots, "a", "ra"), roots, "b", "rb").where("ra != rb").select("a", "b")
    more = stored(_verified(stored(second, "pairs"), sets, similarity), "verified")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.toDF("a", "b")))
    # every text has met the center of each of its keys; left are those of one key that are in
    # different components still
    rows = stored(_rooted(met.select("key", "node", "n"), roots, "node", "root"), "rooted")
    mixed = rows.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("rows"), F.expr(f"1 + sum(8 * n) div {CHUNK_BYTES}").alias("chunks"))
    mixed = stored(mixed.where("r1 != r2").select("key", "chunks", "rows"), "mixed-keys")
    if mixed.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(mixed.drop("rows")), "key")
    else:
        rows = join_counted(rows, mixed, ["key"], "rows").where("chunks is not null")
    rows = stored(rows, "apart")
    if not rows.isEmpty():
        more = stored(_compared(rows, sets, similarity), "verified")
        if not more.isEmpty():
            roots = components(more.unionByName(roots.toDF("a", "b")))
    return roots


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    distance: int = 4, blocks: int = 8, bands: int = 48, rows: int = 3,
) -> DataFrame:
    """docs without all but one row of each group of near copies: the one with the least id stays,
    null ids last, among equal ids the one with the least text hash, and of rows that repeat an id
    and its text one. Groups are the components of the links between texts whose shingle sets have
    at least `similarity`. Texts without words are one group, texts of fewer words than a shingle
    are near only if their words are equal. All columns stay as they are; an empty table stays
    empty."""
    marked = stored(_marked(docs, id_col, text_col, shingle, bands, rows), "marks")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")
    nodes = marked.groupBy("h1", "h2").agg(F.min(key).alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = _links(nodes, docs, id_col, text_col, shingle, similarity, distance, blocks)
    # the first of each component, then of each node; a node without links is its own
    linked = stored(nodes.select("h1", "h2", "node", "least", "rows").join(roots, "node"), "linked")
    first = stored(linked.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("nodes")), "firsts")
    of_linked = join_counted(linked, first, ["root"], "nodes").select("h1", "h2", "first", "rows")
    of_lone = nodes.join(linked.select("node"), "node", "left_anti").select("h1", "h2", F.col("least").alias("first"), "rows")
    by_set = stored(of_linked.unionByName(of_lone), "by-set")
    named = join_counted(marked.select("doc_id", "digest", "h1", "h2"), by_set, ["h1", "h2"], "rows")
    return simhash.survivors(docs, named, id_col, text_col)
