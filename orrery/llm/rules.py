"""Quality rules as a short-circuit cascade.

Each task evaluates every rule on its first documents, measures what a rule costs and how often it
rejects, orders the rules by rejection per cost, and then stops at the first rule that rejects.
The verdict is the conjunction of all rules, so the order never changes it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import tidy

SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 256


class Text:
    """A text whose statistics are computed when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    def __getattr__(self, name: str):
        value = STATISTICS[name](self)
        setattr(self, name, value)
        return value


def _words(t: Text) -> list[bytes]:
    return t.raw.split()


def _word_chars(t: Text) -> int:
    b = np.frombuffer(b"".join(t.words), np.uint8)
    return int(len(b) - np.count_nonzero((b & 0xC0) == 0x80))  # continuation bytes don't count


def _n_symbols(t: Text) -> int:
    return len(t.raw) - len(t.raw.translate(None, SYMBOLS))


def _n_dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _n_repeat_words(t: Text, window: int = 8) -> int:
    """Windows of `window` words get exact numbers by doubling: numbers of pairs of numbers."""
    if t.n_words <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in t.words), np.int64, t.n_words)
    if len(numbers) == t.n_words:
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        _, ids = np.unique(ids[:-step] * np.int64(t.n_words + 1) + ids[step:], return_inverse=True)
        span += step
        if span < window and len(ids) and ids.max() + 1 == len(ids):
            return 0  # all different already
    often = np.bincount(ids)[ids] > 1
    if not often.any():
        return 0
    change = np.zeros(t.n_words + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


STATISTICS: dict[str, Callable[[Text], object]] = {
    "words": _words,
    "n_words": lambda t: len(t.words),
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects(text) is true where the document fails; base rules are the contract's."""

    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


#: Thresholds are whole-number comparisons, so other engines agree to the last row.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda t: t.n_words < 20, base=True),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 30 * t.n_words, base=True),
    Rule("symbols", lambda t: 100 * t.n_symbols > 20 * t.n_words),
    Rule("duplicate_lines", lambda t: t.n_dup_lines > 2 and 100 * t.n_dup_lines > 30 * (t.raw.count(b"\n") + 1)),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 15 * t.n_words),
)


class Cascade:
    """Rules in the order of rejections per second, as measured on the first `sample` texts."""

    def __init__(self, rules: Sequence[Rule], sample: int = SAMPLE_ROWS):
        self.rules, self.left = list(rules), sample
        self.cost = {r.name: 1e-9 for r in rules}
        self.hits = {r.name: 0 for r in rules}

    def keeps(self, t: Text) -> bool:
        if self.left <= 0:
            return not any(r.rejects(t) for r in self.rules)
        verdict = True
        for r in self.rules:
            alone = Text(t.raw)  # a rule pays for all that it needs
            began = time.perf_counter()
            rejected = r.rejects(alone)
            self.cost[r.name] += time.perf_counter() - began
            self.hits[r.name] += rejected
            verdict &= not rejected
        self.left -= 1
        if not self.left:
            self.rules.sort(key=lambda r: -(self.hits[r.name] + 0.5) / self.cost[r.name])
        return verdict


def judge(docs: DataFrame, *, text_col: str = "text", rules: Sequence[Rule] = RULES, sample: int = SAMPLE_ROWS, report: bool = False) -> DataFrame:
    """docs with the column kept and, if report is true, the counts of COUNTS and base_failed.

    A null text is empty: no words, so the first rule rejects it. Input columns named like a result
    are replaced; rows, repeats and all other columns stay. With report the counts are made for
    rejected rows too, after the cascade's verdict.
    """
    results = ["kept", "base_failed", *COUNTS] if report else ["kept"]
    docs = docs.drop(*results)
    names = docs.columns
    base = [r for r in rules if r.base]

    def run(batches):
        cascade = Cascade(rules, sample)
        for b in batches:
            kept, failed, counts = [], [], {c: [] for c in COUNTS}
            for raw in b.column(b.num_columns - 1).to_pylist():
                t = Text(raw)
                kept.append(cascade.keeps(t))
                if report:
                    failed.append(any(r.rejects(t) for r in base))
                    for c in COUNTS:
                        counts[c].append(getattr(t, c))
            made = [pa.array(kept, pa.bool_())]
            if report:
                made += [pa.array(failed, pa.bool_()), *(pa.array(counts[c], pa.int64()) for c in COUNTS)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*names, *results])

    wide = docs.withColumn("kept", F.lit(True))
    if report:
        wide = wide.withColumn("base_failed", F.lit(False)).select("*", *(F.lit(0).cast("long").alias(c) for c in COUNTS))
    return docs.select("*", F.col(text_col).cast("binary").alias("__text_bytes")).mapInArrow(tidy(run), wide.schema)
