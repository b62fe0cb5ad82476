"""Near copies by verified similarity against brute force, with every limit that changes the way set low."""

import random
from collections import Counter

import numpy as np
import pytest

from orrery.llm import _work, copies, lines, links, simhash
from orrery.llm.queries import table as read

from test_llm import SF, classes, prose, table


def brute_copies(rows, shingle=5, similarity=0.8):
    """Ids that stay, by comparing all texts that share a shingle."""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sets[i] = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    near = []
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        near += [(i, j) for j, n in shared.items() if n * n >= similarity**2 * len(s) * len(sets[j]) - 1e-9]
    empty = [i for i, s in sets.items() if not s]
    near += [(i, empty[0]) for i in empty[1:]]
    return set(classes(near, sorted(sets)).values())


def families(seed=8, n=12):
    """Texts of some families: a chain of ever more changes, copies with a few words changed, and
    texts that share half of theirs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [None, "", " \n", "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(n):
        base = [word() for _ in range(rng.choice([12, 60, 200]))]
        own = base
        for _ in range(6):
            own = list(own)
            for _ in range(max(1, len(base) // 60)):
                own[rng.randrange(len(own))] = word()
            texts += [" ".join(own), " ".join(own).upper()]
        texts.append(" ".join(base[: len(base) // 2] + [word() for _ in base[len(base) // 2 :]]))
    return texts


@pytest.mark.parametrize("low", [False, True])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, low):
    if low:
        for module in (_work, copies, links):
            monkeypatch.setattr(module, "HOT", 2)
        monkeypatch.setattr(copies, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(copies, "CHUNK_BYTES", 700)
        monkeypatch.setattr(simhash, "BROADCAST_GONE", -1)
    texts = families()
    docs = table(spark, texts)
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_copies(list(enumerate(texts)))


def test_near_copies_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    kept = copies.keep_one(read(spark, SF, "documents"))
    assert {r.doc_id for r in kept.collect()} == brute_copies(rows)


def test_near_copies_repeats_nulls_and_empty_tables(spark):
    long = prose(random.Random(3), 60)
    docs = table(spark, [long, long, long, long + " more", "other words here now", "other words here now", None, ""], ids=[4, 4, None, 2, 9, 9, 7, None])
    left = sorted((str(r.doc_id), r.text) for r in copies.keep_one(docs).collect())
    assert left == sorted([("2", long + " more"), ("9", "other words here now"), ("7", None)])
    assert copies.keep_one(table(spark, [])).count() == 0


def test_band_keys_are_shared_as_minima_are():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:4500], rng.integers(0, 1 << 63, 500).astype(np.uint64)]))
    keys = [copies.band_keys(x, 400, 1) for x in (a, b)]
    jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert len(keys[0]) == 400 and abs((keys[0] == keys[1]).mean() - jaccard) < 0.08
    least = [copies.band_keys(a[k : k + 100], 4, 1) for k in range(0, 5000, 100)]
    assert all((keys[0][:4] == np.array(least)).any(axis=0))  # a minimum of all is a strip's
    assert not len(copies.band_keys(a[:0], 8, 3))


@pytest.mark.parametrize("distance", [3, 4, 5, 6])
def test_large_buckets_at_any_distance(spark, distance):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(12)}
    for b in list(fps)[:5]:
        for _ in range(12):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    near = [(a, b) for a in fps for b in fps if a > b and ((a ^ b) % (1 << 64)).bit_count() <= distance]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.hamming_links(df, distance=distance, most=2)
    got = {r.node: r.root for r in links.components(found).collect()}
    want = classes(near, fps)
    assert {x: got.get(x, x) for x in fps} == want


def test_components_with_hubs_broadcast(spark, monkeypatch):
    monkeypatch.setattr(links, "HOT", 2)
    pairs = [(100, k) for k in range(101, 140)] + [(i, i + 1) for i in range(20)] + [(139, 5)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(21), *range(100, 140)], 0)


def test_counted_join(spark, monkeypatch):
    monkeypatch.setattr(_work, "HOT", 3)
    left = spark.createDataFrame([(k % 3, i) for i, k in enumerate([0] * 9 + [1, 2, 2])], "k long, v long")
    right = spark.createDataFrame([(0, "hot", 9), (1, "cold", 1)], "k long, name string, rows long")
    got = sorted((r.v, r.k, r.name) for r in _work.join_counted(left, right, ["k"], "rows").collect())
    assert got == [(i, 0, "hot") for i in range(9)] + [(9, 1, "cold"), (10, 2, None), (11, 2, None)]


def test_lines_count_rows_as_documents(spark):
    line = "a line of more than forty characters, held by five rows"
    docs = table(spark, [line] * 6, ids=[1, 1, 1, 1, 1, 2])
    got = sorted((r.doc_id, r.n_dropped, r.kept_text) for r in lines.dedup_lines(docs).collect())
    assert got == [(1, 1, "")] * 5 + [(2, 0, line)]
    few = table(spark, [line] * 4, ids=[1, 1, None, 2])
    assert all(r.n_dropped == 0 for r in lines.dedup_lines(few).collect())
