"""Line dedup over a reversible index: sharded cuckoo filters backed by exact reference counts.

The index knows every long line (its key is the MD5 of the stripped, lower-cased line) with the
documents that hold it. A key held by at least `min_docs` documents is common; each shard's cuckoo
filter holds its common keys, so cleaning a document asks the exact table only about lines that the
filter passes. Documents can be inserted and deleted; keys enter a filter or leave it as their count
crosses `min_docs`.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import broadcast_if, stored, tidy

STRIPPED = b" \t\n\x0b\x0c\r"
#: Filters of at most so many bytes together are broadcast; beyond, lines are dealt to their shards.
BROADCAST_FILTERS = 64 << 20
#: Lines are filed under so many buckets; a shard is one or more whole buckets, of about SHARD_KEYS
#: common keys as long as there are no more shards than buckets. Beyond, filters grow.
BUCKETS, SHARD_KEYS = 4096, 50_000
#: Where lines are dealt to shards, a shard's go to so many tasks, so that a hot line isn't one's.
SPREAD = 16
#: So many (document, line) hits are broadcast at most (16-byte keys, some 30 MB).
BROADCAST_HITS = 400_000


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; takes 64-bit hashes. Deleting what was never inserted
    is an error of the caller, as in every filter of this kind."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) - 1)

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n) / (cls.SLOTS * 0.85)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = np.maximum(hashes >> np.uint64(48), np.uint64(1))
        one = hashes & self.mask
        return mark.astype(np.uint16), one, self._other(one, mark)

    def _other(self, bucket, mark):
        mixed = np.asarray(mark, np.uint64) * np.uint64(0x5BD1E9955BD1E995)
        return np.asarray(bucket, np.uint64) ^ ((mixed >> np.uint64(20)) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._at(hashes)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, value: int) -> bool:
        """False where the filter is too full; it must then be built anew from the exact table."""
        mark, one, two = (int(x[0]) for x in self._at(np.array([value], np.uint64)))
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = two
        for k in range(self.KICKS):
            slot = (bucket + k) % self.SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = int(self._other(bucket, mark))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, value: int) -> bool:
        mark, one, two = (int(x[0]) for x in self._at(np.array([value], np.uint64)))
        for bucket in (one, two):
            held = np.flatnonzero(self.table[bucket] == mark)
            if len(held):
                self.table[bucket, held[0]] = 0
                return True
        return False


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None where it has fewer than min_chars code points."""
    line = line.strip(STRIPPED).lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return md5(line).digest()


def _text_keys(text: bytes | None, min_chars: int) -> list[bytes]:
    """Distinct keys of a text's lines, in order."""
    keys = {k: None for x in (text or b"").split(b"\n") if len(x) >= min_chars and (k := line_key(x, min_chars))}
    return list(keys)


def _bucket(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 64-bit filter hash of each key."""
    halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return (halves[:, 0] % np.uint64(BUCKETS)).astype(np.int64), halves[:, 1].copy()


def _exploded(docs: DataFrame, pick, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, bucket, key), a row for each key that pick(text keys of a batch) leaves."""

    def run(batches):
        for b in batches:
            ids, digests = b.column("id"), b.column("digest")
            at, keys, bucket = pick(b.column("t").to_pylist())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), digests.take(at), pa.array(bucket, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "digest", "bucket", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, digest long, bucket long, key binary")


@dataclass(frozen=True)
class LineIndex:
    """A version of the index: postings (doc_id, digest, bucket, key), counts (bucket, key, n_docs,
    last_id) and filters (shard, filter), all stored tables. Each row inserted is a document,
    whatever its id; `shards` is chosen by build()."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int = 1
    min_docs: int = 5
    min_chars: int = 40
    id_col: str = "doc_id"
    text_col: str = "text"

    @classmethod
    def build(cls, docs: DataFrame, **options) -> LineIndex:
        """The index of docs. Null texts are one empty line and hold no key; null ids count as
        documents but are never the last holder while another holds the line."""
        empty = cls(None, None, None, **options)
        postings = stored(empty._postings(docs), "line-postings")
        counts = stored(cls._counted(postings), "line-counts")
        common = empty._common(counts).count()
        shards = min(BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, common / SHARD_KEYS)))))
        made = empty._with(postings=postings, counts=counts, shards=options.get("shards", shards))
        return made._with(filters=made._filters(counts))

    def _with(self, **changed) -> LineIndex:
        return LineIndex(**{k: getattr(self, k) for k in self.__dataclass_fields__} | changed)

    def _postings(self, docs: DataFrame) -> DataFrame:
        min_chars = self.min_chars

        def pick(texts):
            lists = [_text_keys(t, min_chars) for t in texts]
            keys = [k for x in lists for k in x]
            return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), keys, _bucket(keys)[0]

        return _exploded(docs, pick, self.id_col, self.text_col)

    @staticmethod
    def _counted(postings: DataFrame) -> DataFrame:
        return postings.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_id"))

    def _common(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= self.min_docs)

    def _sharded(self, counts: DataFrame) -> DataFrame:
        """(shard, key) of the common keys."""
        return self._common(counts).select((F.col("bucket") % self.shards).alias("shard"), "key")

    def _filters(self, counts: DataFrame) -> DataFrame:
        def fill(key, table):
            keys = table.column("key").to_pylist()
            hashes, room = _bucket(keys)[1].tolist(), len(keys)
            while True:
                made = CuckooFilter.for_keys(room)
                if all(made.insert(h) for h in hashes):
                    return pa.table({"shard": [key[0].as_py()], "filter": pa.array([made.dump()], pa.binary())})
                room *= 2

        return stored(self._sharded(counts).groupBy("shard").applyInArrow(fill, "shard long, filter binary"), "line-filters")

    def _changed(self, counts: DataFrame, was: DataFrame, now: DataFrame) -> DataFrame:
        """Filters after the counts of some keys have changed from `was` to `now`: of these, keys that became common
        go in, others come out. A filter that gets too full is built anew from the exact counts."""
        was, now = self._sharded(was).withColumn("into", F.lit(False)), self._sharded(now).withColumn("into", F.lit(True))
        moves = was.unionByName(now).groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n"), F.max("into").alias("into")).where("n = 1").drop("n")
        moves = moves.repartition("shard")

        def change(key, filters, moved):
            made = CuckooFilter.load(filters.column("filter")[0].as_py()) if filters.num_rows else CuckooFilter.for_keys(moved.num_rows)
            full = False
            if moved.num_rows:
                keys, into = moved.column("key").to_pylist(), moved.column("into").to_pylist()
                for h, goes_in in sorted(zip(_bucket(keys)[1].tolist(), into, strict=True), key=lambda x: x[1]):
                    full |= not (made.insert(h) if goes_in else made.delete(h))
            return pa.table({"shard": [key[0].as_py()], "filter": pa.array([None if full else made.dump()], pa.binary())})

        changed = stored(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(change, "shard long, filter binary"), "line-filters")
        full = changed.where("filter is null").select("shard")
        if full.isEmpty():
            return changed
        anew = self._filters(counts.join(full, F.col("bucket") % self.shards == F.col("shard"), "left_semi"))
        return stored(changed.where("filter is not null").unionByName(anew), "line-filters")

    def _recounted(self, postings: DataFrame, now: DataFrame) -> LineIndex:
        """The index with these postings, where the keys of `now` (a stored table of counts, n_docs 0 for none) have
        changed: only they are compared with what was, and only the filters of their shards change."""
        touched = now.select("bucket", "key")
        was = stored(self.counts.join(touched, ["bucket", "key"], "left_semi").select(now.columns), "line-were")
        left = now.where("n_docs > 0")
        counts = stored(self.counts.join(touched, ["bucket", "key"], "left_anti").select(now.columns).unionByName(left), "line-counts")
        return self._with(postings=postings, counts=counts, filters=self._changed(counts, was, left))

    def insert(self, docs: DataFrame) -> LineIndex:
        """With docs as well. Their keys are counted and added to the counts of these keys alone."""
        new = stored(self._postings(docs), "line-postings")
        more = self._counted(new)
        known = self.counts.join(more.select("bucket", "key"), ["bucket", "key"], "left_semi").select(more.columns)
        now = known.unionByName(more).groupBy("bucket", "key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))
        return self._recounted(self.postings.unionByName(new), stored(now, "line-now"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents whose ids are in the first column of ids; as if they had never been
        inserted. Only the keys that they held are counted again."""
        ids = ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct()
        postings = stored(self.postings.join(ids, "doc_id", "left_anti").select(self.postings.columns), "line-postings")
        touched = stored(self.postings.join(ids, "doc_id", "left_semi").select("bucket", "key").distinct(), "line-touched")
        again = self._counted(postings.join(touched, ["bucket", "key"], "left_semi"))
        now = touched.join(again, ["bucket", "key"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long")))
        return self._recounted(postings, stored(now.select(again.columns), "line-now"))

    def _candidates(self, docs: DataFrame) -> DataFrame:
        """(doc_id, digest, bucket, key) of the lines that a filter passes."""
        size = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        if size > BROADCAST_FILTERS:
            return self._passed(self._postings(docs))
        held = self.filters.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})
        shards, min_chars = self.shards, self.min_chars
        loaded: dict[int, CuckooFilter] = {}

        def pick(texts):
            if not loaded and held.value:
                loaded.update((k, CuckooFilter.load(v)) for k, v in held.value.items())
            lists = [_text_keys(t, min_chars) for t in texts]
            keys = [k for x in lists for k in x]
            bucket, hashes = _bucket(keys)
            shard, hit = bucket % shards, np.zeros(len(keys), bool)
            for k in np.unique(shard).tolist():
                if k in loaded:
                    of = np.flatnonzero(shard == k)
                    hit[of] = loaded[k].contains(hashes[of])
            at = np.flatnonzero(hit)
            return np.repeat(np.arange(len(lists)), [len(x) for x in lists])[at], [keys[i] for i in at.tolist()], bucket[at]

        return _exploded(docs, pick, self.id_col, self.text_col)

    def _passed(self, postings: DataFrame) -> DataFrame:
        """The postings that their shard's filter passes, where the filters are too large for one
        task. Each shard's lines are dealt to SPREAD tasks, each with a copy of the filter, which
        comes first there; a task holds one filter and one batch."""
        columns = postings.columns
        to = F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SPREAD))
        asked = postings.select((F.col("bucket") % self.shards).alias("shard"), to.alias("task"), F.lit(None).cast("binary").alias("filter"), *columns)
        held = self.filters.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("task"), "filter")
        rows = held.unionByName(asked, allowMissingColumns=True).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("filter").isNull())

        def run(batches):
            of, own = None, None
            for b in batches:
                at = np.stack([b.column("shard").to_numpy(), b.column("task").to_numpy()])
                filters = b.column("filter")
                passed = np.zeros(b.num_rows, bool)
                cut = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
                for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                    if s == e:
                        continue
                    if of != (key := tuple(at[:, s].tolist())):
                        of, own = key, None
                    if filters[s].is_valid:
                        own, s = CuckooFilter.load(filters[s].as_py()), s + 1
                    if own is not None and s < e:
                        passed[s:e] = own.contains(_bucket(b.column("key").slice(s, e - s).to_pylist())[1])
                yield b.select(columns).filter(pa.array(passed))

        return rows.mapInArrow(tidy(run), postings.schema)

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with kept_text, n_lines and n_dropped.

        A line goes if its key is common and the document is not the one with the largest id that
        holds it. A null or empty text is one empty line and stays so (kept_text ''). Rows that
        share the largest id all keep the line. Input columns named like the three are replaced.
        """
        results = ["kept_text", "n_lines", "n_dropped"]
        docs = docs.drop(*results)
        names, min_chars = docs.columns, self.min_chars
        common = self._common(self.counts).select("bucket", "key", "last_id")
        gone = self._candidates(docs).join(common, ["bucket", "key"]).where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        hits = stored(gone.select("doc_id", "digest", "key").distinct(), "line-hits")
        lists = hits.groupBy(F.col("doc_id").alias("__hit_id"), F.col("digest").alias("__hit_digest")).agg(F.collect_list("key").alias("__hit_keys"))
        lists = broadcast_if(lists, hits.count(), BROADCAST_HITS)
        on = docs[self.id_col].eqNullSafe(F.col("__hit_id")) & (F.xxhash64(docs[self.text_col]) == F.col("__hit_digest"))
        joined = docs.join(lists, on, "left").select(*(docs[c] for c in names), docs[self.text_col].cast("binary").alias("__text_bytes"), "__hit_keys")

        schema = docs.select("*", F.lit("").alias("kept_text"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
        return joined.mapInArrow(tidy(_rebuild(names, min_chars)), schema)


def _rebuild(names: Iterable[str], min_chars: int):
    names = [*names, "kept_text", "n_lines", "n_dropped"]

    def run(batches):
        for b in batches:
            kept, lines, dropped = [], [], []
            for text, keys in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                text = text or b""
                n = left = text.count(b"\n") + 1
                if keys:
                    gone = set(keys)
                    stay = [x for x in text.split(b"\n") if len(x) < min_chars or line_key(x, min_chars) not in gone]
                    text, left = b"\n".join(stay), len(stay)
                kept.append(text)
                lines.append(n)
                dropped.append(n - left)
            made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], names)

    return run


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs cleaned by the index of docs themselves."""
    return LineIndex.build(docs, **options).clean(docs)
