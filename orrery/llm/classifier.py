"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Features of a text are its word unigrams and bigrams and the n-grams, to three, of its words'
shapes (runs of lower case, upper case, digits; other signs kept; a mark where a word repeats the
one before it). Each n-gram counts once, hashed to one of 2**bits weights.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import tidy

BITS = 18
#: Labelled rows that training takes at most, those with the least MD5 of doc_id.
MAX_TRAINING_ROWS = 12_000
#: Training goes through its rows until it has made so many updates, at least and at most so often: few
#: rows need more passes for a score of 0.5 to lie between the classes.
UPDATES, LEAST_EPOCHS, MOST_EPOCHS = 48_000, 4, 64
SEGMENT = 1 << 20  # bytes hashed at once

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[0x80:] = 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if _POWERS.get(0, (np.empty(0),))[0].size < size:
        _POWERS[0] = (_powers(_BASE, size), _powers(_INVERSE, size))
    return _POWERS[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M
    return h ^ (h >> np.uint64(32))


def _hash_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the shapes of the words in a run of bytes."""
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    power, inverse = _tables(len(b) + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])))
    words = (sums[ends] - sums[starts]) * inverse[starts]
    kind = _CLASS[b]
    kept = np.ones(len(b), bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept &= ~space
    at = np.concatenate(([0], np.cumsum(kept)))
    sums = np.concatenate(([np.uint64(0)], np.cumsum((kind[kept] + np.uint64(1)) * power[: at[-1]])))
    shapes = (sums[at[ends]] - sums[at[starts]]) * inverse[at[starts]]
    return _mixed(words), _mixed(shapes)


def _segments(text: bytes):
    """Runs of about SEGMENT bytes, cut between words."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = max(text.rfind(s, at, at + SEGMENT) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:  # one word fills the segment: to its end
            found = [p for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(s, at + SEGMENT)) >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct weights' numbers of a UTF-8 text; empty for a text without words."""
    parts = [_hash_words(np.frombuffer(s, np.uint8)) for s in _segments(text)]
    words = np.concatenate([p[0] for p in parts])
    shapes = np.concatenate([p[1] for p in parts])
    if not len(words):
        return np.empty(0, np.int64)
    shapes[1:] += (words[1:] == words[:-1]).astype(np.uint64)
    shapes = np.unique(shapes, return_inverse=True)
    names, at = shapes
    width = np.int64(len(names))
    two, pair = np.unique(at[:-1] * width + at[1:], return_inverse=True)
    three = np.unique(pair[:-1] * width + at[2:])  # pairs are numbered: below the square of the words, whatever the width
    first = two[three // width]
    t = names[first // width] * np.uint64(5) + names[first % width] * np.uint64(3) + names[three % width]
    groups = (
        words,
        words[:-1] * np.uint64(3) + words[1:],
        names + np.uint64(11),
        names[two // width] * np.uint64(7) + names[two % width],
        t + np.uint64(13),
    )
    hashed = np.concatenate([_mixed(g + np.uint64(101 * k)) for k, g in enumerate(groups)])
    return np.unique((hashed >> np.uint64(64 - bits)).astype(np.int64))


@dataclass(frozen=True)
class Model:
    """weights[i] of feature i, bias last."""

    weights: np.ndarray
    bits: int = BITS

    def score(self, text: bytes) -> float:
        x = features(text, self.bits)
        total = float(self.weights[-1])
        if len(x):
            total += float(self.weights[x].sum(dtype=np.float64)) / float(np.sqrt(len(x)))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int | None = None, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> np.ndarray:
    """Weights after `epochs` passes over rows of (features, label) in the order given; by default as many
    as UPDATES asks for."""
    epochs = epochs or min(MOST_EPOCHS, max(LEAST_EPOCHS, -(-UPDATES // max(1, len(rows)))))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    bias = 1 << bits
    for _ in range(epochs):
        for x, y in rows:
            i = np.append(x, bias).astype(np.int64)
            v = np.full(len(i), 1 / np.sqrt(max(1, len(x))))
            v[-1] = 1.0
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -30, 30))) - y) * v
            moved = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - moved * w
            n[i] += g * g
    return weights(np.arange((1 << bits) + 1)).astype(np.float32)


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by 3 are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS, bits: int = BITS) -> Model:
    """Learn label_col from the labelled rows that are not held out, at most max_rows of them.

    The rows are chosen on the labels alone; their hashed features, not their texts, go to the one
    task that does the updates, and at most 2**bits + 1 weights to the driver. Null ids and null
    labels are left out; of several labels of one id the largest counts, and of several texts of one
    id the first by hash. Without usable labels every weight is 0 and every score 0.5.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(chosen), "doc_id")

    def to_features(batches):
        for b in batches:
            x = [features(t or b"", bits).astype(np.int32).tobytes() for t in b.column("t").to_pylist()]
            keys = [zlib.crc32(k) for k in x]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.binary()), pa.array(keys, pa.int64())], ["doc_id", "y", "x", "k"])

    hashed = rows.select("doc_id", "y", "t").mapInArrow(tidy(to_features), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary, k long")

    def fit(batches):
        seen, data = set(), []
        for b in batches:
            for i, y, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "y", "x")), strict=True):
                if i not in seen:
                    seen.add(i)
                    data.append((np.frombuffer(x, np.int32), y))
        w = ftrl(data, bits) if data else np.zeros((1 << bits) + 1, np.float32)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float32())], ["i", "w"])

    order = [F.md5(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("k")]
    learnt = hashed.repartition(1).sortWithinPartitions(*order).mapInArrow(tidy(fit), "i long, w float").toArrow()
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[learnt.column("i").to_numpy()] = learnt.column("w").to_numpy()
    return Model(weights, bits)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`, a double from 0 to 1. Null and empty texts get the bias's score.
    An input column named `out` is replaced; rows, repeats and other columns stay as they are."""
    docs = docs.drop(out)
    names = docs.columns
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # 2**bits + 1 floats
    bits = model.bits

    def run(batches):
        m = Model(weights.value, bits)
        for b in batches:
            s = pa.array([m.score(t or b"") for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], [*names, out])

    schema = docs.withColumn(out, F.lit(0.0)).schema
    return docs.select("*", F.col(text_col).cast("binary").alias("__text_bytes")).mapInArrow(tidy(run), schema)
