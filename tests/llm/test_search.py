"""Neighbours and ranked search against brute force, with the edges their docstrings state."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from orrery.llm import neighbours, ranking


def exact(rows, queries, k):
    """(query, rank, id, score) by brute force over (id, vector) rows."""
    rows = [(i, np.asarray(v, float)) for i, v in rows]
    out = []
    for at, (q, v) in enumerate(rows):
        if queries(q):
            others = [(-float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w))), i) for b, (i, w) in enumerate(rows) if b != at]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(others)[:k])]
    return sorted(out)


def found(spark, rows, queries, k=5, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.neighbours(df, queries, k, **how)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def vectors(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def same(got, want):
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)


def test_neighbours_equal_brute_force_on_a_small_table(spark):
    rows = vectors(300, 12, 1)
    got, want = found(spark, rows, F.pmod("vec_id", F.lit(10)) == 0), exact(rows, lambda i: i % 10 == 0, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    same(got, want)


def test_equal_vectors_are_rows_of_their_own_and_ties_fall_to_the_smaller_id(spark):
    rows = vectors(120, 6, 2)
    rows = [(i, rows[7][1] if i % 3 == 0 else v) for i, v in rows]  # a third of all rows
    rows += [(9, rows[9][1]), (10, rows[11][1])]  # repeated ids, with the same and with another vector
    got, want = found(spark, rows, F.pmod("vec_id", F.lit(3)) < 2), exact(rows, lambda i: i % 3 < 2, 5)
    same(got, want)
    hot = [x for x in got if x[0] == 30]
    assert [x[2] for x in hot] == [0, 3, 6, 7, 9]


def test_fewer_candidates_than_asked_for_and_odd_vectors(spark):
    bad = [(90, None), (91, []), (92, [0.0, 0.0]), (93, [1.0, None]), (94, [float("nan"), 1.0]), (95, [float("inf"), 1.0]), (96, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-1e-30, 1e-30])]
    got = found(spark, rows + bad, F.col("vec_id") >= 0)
    same(got, exact(rows, lambda i: True, 5))
    assert found(spark, bad[:6], F.col("vec_id") >= 0) == []
    assert found(spark, rows[:1], F.col("vec_id") >= 0) == []
    df = spark.createDataFrame([(0, [1.0], 5, "x"), (1, [2.0], 6, "y")], "vec_id long, embedding array<double>, rank int, node string")
    assert [(r.query_id, r.vec_id) for r in neighbours.neighbours(df, F.col("vec_id") == 1).collect()] == [(1, 0)]


def test_rounds_of_descent_find_what_the_leaves_miss(spark):
    rows = vectors(1500, 10, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = neighbours.classes(df, "vec_id", "embedding", 6).select("node", "vec")
    want = {(q, i) for q, _, i, _ in exact(rows, lambda i: i % 20 == 0, 5)}

    def recall(rounds):
        graph = neighbours.build(nodes, k=16, reverse=16, trees=2, rounds=rounds, leaf=16, cell=128)
        names = {r.n: r.node.id for r in graph["codes"].collect()}
        have = {(names[r.n], names[c]) for r in graph["lists"].collect() for c in r.c}
        return len(want & have) / len(want), graph["rounds"]

    first, last = recall(0), recall(10)
    assert first[0] < 0.5 < 0.95 < last[0]
    assert 1 < last[1] < 10  # it ended by itself


def test_queries_that_are_not_rows_start_at_entries(spark):
    rows = vectors(1000, 8, 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graph = neighbours.build(neighbours.classes(df, "vec_id", "embedding", 6).select("node", "vec"), k=16, reverse=16)
    asked = np.random.default_rng(5).standard_normal((20, 8))
    codes = [(i, bytearray(c.tobytes()), None) for i, c in enumerate(neighbours._codes(asked))]
    beams = neighbours.search(graph, spark.createDataFrame(codes, "q long, code binary, n long"), 40).collect()
    names = {r.n: r.node.id for r in graph["codes"].collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = [len({names[x.n] for x in b.nodes[:5]} & set(np.argsort(-(m @ asked[b.q]))[:5].tolist())) / 5 for b in beams]
    assert len(hit) == 20 and np.mean(hit) >= 0.9


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    """(item, rank, doc, score) by the formula, document by document."""
    held = [(i, Counter(lowered(t))) for i, t in docs]
    n_all, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted({x for x in items if x[1]}, key=str):
        scores = []
        for doc, c in held:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * n_all) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(lowered(text)) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10, shard=1 << 20, block=1 << 20):
    shards = ranking.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_bytes=shard)
    got = ranking.search(shards, spark.createDataFrame(items, "item_id long, text string"), k, block_bytes=block)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str)


WORDS = ["the", "The", "of", "straße", "naïve", "x1", "zebra", "quartz", "日本", "a-b", "C++", " ", "end."]


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_ranking_equals_the_formula(spark, size):
    rng = np.random.default_rng(6)
    p = 1 / np.arange(1, len(WORDS) + 1)
    text = lambda n: " ".join(rng.choice(WORDS, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(0, 30)))) for i in range(150)]
    docs += [(i, docs[0][1]) for i in range(200, 215)]  # copies tie
    docs += [(3, "zebra zebra"), (None, "zebra quartz"), (None, None), (400, None), (401, ""), (402, " .,; "), (403, "quartz " * 3000)]
    items = [(i, text(6)) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (23, "unheard"), (0, "zebra"), (5, "quartz zebra"), (5, "quartz zebra"), (None, "zebra")]
    assert searched(spark, docs, items, shard=size) == ranked(docs, items)
    assert searched(spark, docs, items, 3, size) == ranked(docs, items, 3)


def test_items_in_several_blocks(spark):
    docs = [(1, "red green"), (2, "green blue blue"), (3, "grey")]
    items = [(1, "red blue"), (2, "green"), (3, "grey red green blue")]
    assert searched(spark, docs, items, block=16) == ranked(docs, items)


def test_large_shards_are_a_row_group_each(spark):
    """A task that writes or reads shards holds a few of them, not all of its own."""
    docs = spark.range(8, numPartitions=1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 200000), i -> hex(xxhash64(id, i))), ' ') AS text")
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in ranking.index(docs).inputFiles()]
    rows = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert sum(rows) == 4 and max(rows) == 1


def test_ranking_of_empty_tables_and_other_columns(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, "!")], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b", 3, "s")], "doc_id long, text string, score int, shard string")
    items = spark.createDataFrame([("i", "b", 1, 2)], "item_id string, text string, rank int, doc_id int")
    got = ranking.search(ranking.index(docs), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [(r.item_id, r.doc_id) for r in got.collect()] == [("i", 1)]


def test_maxscore_is_exact_and_reads_fewer_postings():
    rng = np.random.default_rng(7)
    saved = 0
    for _ in range(200):
        n = int(rng.integers(1, 400))
        lists = []
        for weight in (10_000, 3000, 40, 9, 3, 1):
            docs = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False))
            lists.append((docs, rng.integers(0, weight + 1, len(docs))))
        want = np.zeros(n, np.int64)
        for d, a in lists:
            want[d] += a
        least = int(rng.choice([0, 0, np.sort(want)[-1]]))
        total, tally = np.zeros(n, np.int64), Counter()
        may = ranking.best(lists, 5, total, least, tally)
        cut = max(1, least, np.sort(want)[-5] if n > 5 else 0)
        assert set(may.tolist()) == set(np.nonzero(want >= cut)[0].tolist())
        assert (total[may] == want[may]).all()
        saved += sum(len(d) for d, _ in lists) - tally["added"] - tally["probed"]
    assert saved > 0
