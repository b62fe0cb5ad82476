"""The prefix-filtered join of sets against all pairs."""

import random

import pytest

from orrery.operators import support


@pytest.mark.parametrize(("least", "hot"), [(0.2, 10_000), (0.5, 7), (0.75, 3), (1.0, 3)])
def test_pairs_are_those_of_all_pairs(spark, least, hot):
    rng = random.Random(hot)
    rare = [1 / (1 + i) for i in range(25)]
    sets = {s: frozenset(rng.choices(range(25), rare, k=rng.randint(1, 9))) for s in range(70)}
    sets |= {100 + s: sets[s] for s in range(12)}  # equal sets
    rows = [(s, f"t{t}") for s, own in sets.items() for t in own]
    got = {(r.u, r.v): (r.shared, r.jaccard) for r in support.similar_terms(spark.createDataFrame(rows + rows[:9], "symbol int, term string"), least, hot).collect()}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_term_that_all_symbols_have_makes_no_pairs(spark):
    rows = [(s, t) for s in range(400) for t in ("all", f"a{s}", f"b{s}")]
    plan = support.similar_terms(spark.createDataFrame(rows, "symbol int, term string"), 0.6)
    assert plan.count() == 0


def _joined(node) -> int:
    """Rows that the joins of an executed plan made."""
    name, seq = node.nodeName(), node.children()
    below = [seq.apply(i) for i in range(seq.size())]
    if name == "AdaptiveSparkPlan":
        below = [node.executedPlan()]
    elif hasattr(node, "plan") and "QueryStage" in name:
        below = [node.plan()]
    own = node.metrics().get("numOutputRows").get().value() if "Join" in name else 0
    return own + sum(map(_joined, below))


def test_equal_sets_are_compared_once(spark, monkeypatch):
    monkeypatch.setattr(support, "MEMBERS", 16, raising=False)
    sets = [{"a", "b", "c"}, {"b", "c", "d"}, {"x", "y", "z"}]
    rows = [(i * 3 + s, t) for s, own in enumerate(sets) for t in own for i in range(90)]
    df = support.similar_terms(spark.createDataFrame(rows, "symbol int, term string"), 0.4)
    got = {(r.u, r.v) for r in df.collect()}
    want = {(u, v) for v in range(270) for u in range(v) if u % 3 == v % 3 or {u % 3, v % 3} == {0, 1}}
    assert got == want and df.count() == len(want)
    assert 0 < _joined(df._jdf.queryExecution().executedPlan()) < 2_000 < len(want)
