"""Ranked lexical search: an inverted index in shards, and MaxScore within each.

A shard is one row: some documents of one task, at most `SHARD_BYTES` of text (a longer document is a
shard of its own), with the postings of all their terms. Terms are runs of letters and digits of ASCII
and of any character beyond it, A-Z lower-cased. A search takes its items in blocks of bounded size;
each shard answers them where it is, and only its best rows move.

MaxScore: an item's terms are taken by falling upper bound, the most a posting of the shard adds. For as
long as the bounds of the terms left add up to the k-th best score so far, their lists are essential and
each of their documents may enter. After that they are not: no new document can reach the k best, and
postings are probed for those documents alone that still can. Scores are 64-bit integers and bounds are
exact, so the k best are the right ones, ties by smaller id included.

Null and empty texts have no terms: as documents they are not counted, as items they have no result.
Documents are rows, whatever their ids; repeated rows rank one after the other, null ids last among
equals. Items that agree in id and text are one. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import stored, tidy

#: Bytes of text of a shard.
SHARD_BYTES = 8 << 20
#: Bytes of item texts of a block; its terms and their weights go to every task.
BLOCK_BYTES = 4 << 20

#: Each byte of a term as it is kept, each other byte as a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = "shard long, ids array<bigint>, lengths array<bigint>, terms array<binary>, ends array<int>, docs array<int>, counts array<bigint>"
_ARROW = pa.schema(
    [("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary()))]
    + [("ends", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)
#: Sorts after every id.
_LAST = np.iinfo(np.int64).max


def terms(text: str | bytes | None) -> list[bytes]:
    text = text.encode() if isinstance(text, str) else text or b""
    return text.translate(_TERM).split()


def _shard(number: int, ids: list, texts: list) -> pa.RecordBatch:
    lists, lengths = {}, []
    for at, text in enumerate(texts):
        found = terms(text)
        lengths.append(len(found))
        for term, n in Counter(found).items():
            if (own := lists.get(term)) is None:
                own = lists[term] = ([], [])
            own[0].append(at)
            own[1].append(n)
    vocabulary = sorted(lists)
    ends = np.cumsum([len(lists[t][0]) for t in vocabulary], dtype=np.int64)
    flat = [[x for t in vocabulary for x in lists[t][side]] for side in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number, ids, lengths, vocabulary, ends.tolist(), *flat), _ARROW, strict=True)], schema=_ARROW)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of a table, stored in the shared folder."""

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        ids, texts, held, n = [], [], 0, 0
        for b in batches:
            for i, t in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                size = len(t) if t else 0
                if ids and held + size > shard_bytes:
                    yield _shard(first + n, ids, texts)
                    ids, texts, held, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(t)
                held += size
        if ids:
            yield _shard(first + n, ids, texts)

    return stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(tidy(run), INDEX), "ranking-index", large_rows=True)


def _column(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch[name][row].values.to_numpy(zero_copy_only=False)


def _frequencies(wanted: set[bytes]):
    """How many documents of each shard hold each of the terms that are asked for."""

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                sizes = np.diff(_column(b, "ends", row), prepend=0).tolist()
                found = [(t, n) for t, n in zip(b["terms"][row].values.to_pylist(), sizes, strict=True) if t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())], ["term", "df"])

    return run


def best(lists: list[tuple[np.ndarray, np.ndarray]], k: int, total: np.ndarray, least: int = 0, tally: Counter | None = None) -> np.ndarray:
    """Documents of a shard that may be among the k of the highest sum over lists (documents ascending, what each adds >= 0):
    all with that sum or more that k have, here or, as `least` says, elsewhere. Their sums are in `total`, which is all zero before and has to be
    made so again by the caller. tally counts the postings that were added in full and probed."""
    bounds = [int(x[1].max()) for x in lists]
    order = sorted(range(len(lists)), key=lambda i: -bounds[i])
    left = sum(bounds)
    at = 0
    while at < len(order) and left >= max(least, 1):
        docs, adds = lists[order[at]]
        total[docs] += adds
        left -= bounds[order[at]]
        at += 1
        if tally is not None:
            tally["added"] += len(docs)
        if at < len(order) and left:
            reached = total[total > least]
            least = int(np.partition(reached, len(reached) - k)[len(reached) - k]) if len(reached) >= k else least
    may = np.nonzero(total >= max(1, least - left))[0]
    for i in order[at:]:  # not essential
        docs, adds = lists[i]
        own = np.searchsorted(docs, may)
        own[own == len(docs)] = 0
        hit = docs[own] == may
        total[may[hit]] += adds[own[hit]]
        left -= bounds[i]
        if tally is not None:
            tally["probed"] += len(may)
        sums = total[may]
        if len(may) > k:
            least = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        may = may[sums >= max(1, least - left)]
    sums = total[may]
    least = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k])) if len(may) > k else least
    return may[sums >= max(1, least)]


def _answers(items: list[list[int]], weights: dict[bytes, tuple[int, int]], n_all: int, n_terms: int, k: int):
    """A task's k best documents of each item, over its shards. items: the numbers of each item's terms; weights:
    number and weight of each term."""

    def run(batches):
        none = np.zeros(0, np.int64)
        top = [(none, none)] * len(items)  # ids and scores, the best first
        for b in batches:
            for row in range(b.num_rows):
                ids = b["ids"][row].values.fill_null(_LAST).to_numpy()
                m = 10 + (90 * _column(b, "lengths", row) * n_all) // n_terms
                ends, docs, counts = (_column(b, c, row) for c in ("ends", "docs", "counts"))
                postings = {}
                for i, t in enumerate(b["terms"][row].values.to_pylist()):
                    if t in weights:
                        number, w = weights[t]
                        part = slice(ends[i - 1] if i else 0, ends[i])
                        d, tf = docs[part], counts[part]
                        postings[number] = d, w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[d]))
                total = np.zeros(len(ids), np.int64)
                for item, numbers in enumerate(items):
                    lists = [postings[x] for x in numbers if x in postings]
                    if not lists:
                        continue
                    had, scores = top[item]
                    may = best(lists, k, total, int(scores[-1]) if len(scores) == k else 0)
                    d, s = np.concatenate((had, ids[may])), np.concatenate((scores, total[may]))
                    order = np.lexsort((d, -s))[:k]
                    top[item] = d[order], s[order]
                    total[:] = 0
        sizes = [len(x[0]) for x in top]
        d, s = (np.concatenate([none, *(x[side] for x in top)]) for side in (0, 1))
        i = np.repeat(np.arange(len(items)), np.array(sizes, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(d, pa.int64(), mask=d == _LAST), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return run


def search(shards: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents."""
    spark = shards.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("length(text) > 0").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / block_bytes)
    sums = shards.select(F.size(F.filter("lengths", lambda x: x > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n_all, n_terms = sums[0] or 0, sums[1] or 0
    out = None
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # block_bytes of text
        sets = [set(terms(x.text)) for x in own]
        found = shards.select("terms", "ends").mapInArrow(tidy(_frequencies(set().union(*sets))), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = {bytes(x.term): (i, math.floor(1000 * math.log((2 * n_all + 2) / (2 * x.df + 1)))) for i, x in enumerate(found)}
        numbers = [sorted(weights[t][0] for t in s if t in weights) for s in sets]
        answers = shards.mapInArrow(tidy(_answers(numbers, weights, n_all, max(n_terms, 1), k)), "item long, doc_id long, score long")
        names = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(own)], f"item long, item_id {kind}")
        order = F.struct((-F.col("score")).alias("minus"), F.col("doc_id").isNull().alias("none"), "doc_id")
        some = answers.groupBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("best"))
        top = some.groupBy("item").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        top = top.join(F.broadcast(names), "item").select("item_id", F.posexplode("best").alias("i", "x"))
        top = top.select("item_id", (F.col("i") + 1).alias("rank"), "x.doc_id", (-F.col("x.minus")).alias("score"))
        out = top if out is None else out.unionByName(top)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
