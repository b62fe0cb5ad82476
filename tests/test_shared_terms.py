"""Pairs of term sets, a block of symbols against a block, against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions.stats import half_up
from orrery.operators import support


def _shuffled(node) -> int:
    """Rows that the exchanges of an executed plan moved."""
    name, seq = node.nodeName(), node.children()
    below = [seq.apply(i) for i in range(seq.size())]
    if name == "AdaptiveSparkPlan":
        below = [node.executedPlan()]
    elif hasattr(node, "plan") and "QueryStage" in name:
        below = [node.plan()]
    own = node.metrics().get("shuffleRecordsWritten").get().value() if name == "Exchange" else 0
    return own + sum(map(_shuffled, below))


@pytest.mark.parametrize(("block", "dense", "kind"), [(2048, 512, "int"), (7, 512, "string"), (7, 0, "int")])
def test_pairs_are_those_of_all_pairs(spark, monkeypatch, block, dense, kind):
    monkeypatch.setattr(support, "DENSE", dense, raising=False)
    monkeypatch.setattr(support, "BLOCK_SYMBOLS", block, raising=False)
    rng = random.Random(block)
    sets = {s: frozenset(rng.choices("abcdefghij", [1 / (1 + i) for i in range(10)], k=rng.randint(1, 6))) for s in range(60)}
    name = (lambda s: s) if kind == "int" else (lambda s: f"é{s}")
    rows = [(name(s), t) for s, own in sets.items() for t in own]
    df = spark.createDataFrame([*rows, *rows[:5], (None, "a"), (name(3), None)], f"symbol {kind}, term string")
    sets = {name(s): own for s, own in sets.items()}
    n = {t: sum(t in x for x in sets.values()) for t in "abcdefghij"}
    n["a"] += 1  # the row without a symbol counts for its term
    ic = {t: math.log((len(sets) + 1) / (n[t] + 1)) for t in n}
    size = {s: len(x) for s, x in sets.items()}
    pairs = {(u, v): sets[u] & sets[v] for u in sets for v in sets if u < v and sets[u] & sets[v]}
    plan = support.shared_terms(df)
    got = {(r.u, r.v): r for r in plan.collect()}
    assert got.keys() == pairs.keys() and plan.count() == len(pairs)
    assert _shuffled(plan._jdf.queryExecution().executedPlan()) < 300 < len(pairs)
    more = lambda s: size[s] + (s == name(3))
    assert all(got[u, v].shared == len(x) and got[u, v].jaccard == pytest.approx(len(x) / (more(u) + more(v) - len(x))) for (u, v), x in pairs.items())
    sums = {s: sum(ic[t] for t in x) for s, x in sets.items()}
    got = {(r.u, r.v): r for r in support.semantic_similarity(df).collect()}
    assert got.keys() == pairs.keys()
    for (u, v), x in pairs.items():
        r = got[u, v]
        assert [r.lin, r.resnik, r.overlap] == pytest.approx([2 * sum(ic[t] for t in x) / (sums[u] + sums[v]), max(ic[t] for t in x), len(x) / min(size[u], size[v])])


@pytest.mark.parametrize("meeting", [0, 10**9])
def test_similar_sets_either_way(spark, monkeypatch, meeting):
    monkeypatch.setattr(support, "MEETING", meeting)
    rng = random.Random(2)
    sets = {s: frozenset(rng.choices(range(12), k=rng.randint(1, 6))) for s in range(50)}
    rows = [(s, f"t{t}") for s, own in sets.items() for t in own]
    got = {(r.u, r.v): (r.shared, r.jaccard) for r in support.similar_terms(spark.createDataFrame(rows, "symbol int, term string"), 0.3, digits=6).collect()}
    both = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    assert got == {k: (x, round(x / y, 6)) for k, (x, y) in both.items() if x >= 0.3 * y - 1e-9}


def test_no_symbols(spark):
    empty = spark.createDataFrame([], "symbol string, term string")
    assert support.shared_terms(empty).collect() == [] == support.semantic_similarity(empty).collect()


def test_half_up_is_round(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.random(2000), rng.integers(0, 10**8, 2000) / 1e7, -rng.integers(0, 10**8, 500) / 1e7, [0.0, 0.5, 1e-7, 5e-7, 0.0000015, 1.0000005, 2.675, 1e13 + 0.123]]
    want = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").select("i", F.round("x", 6).alias("y")).orderBy("i").collect()]
    assert half_up(x, 6).tolist() == want
