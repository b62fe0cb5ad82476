"""The classifier and the stages of the pipeline against plain Python, and cases at the edges."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import classifier, exact, lines, mixing, packing, rules, sharding, substrings, warc
from orrery.llm.queries import table as read
from orrery.llm.queries import tokenizer_path

from test_copies import brute_copies
from test_llm import SF, brute_lines, prose, table

M64 = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 29)) * 0x9E3779B97F4A7C15 & M64
    return h ^ (h >> 32)


def poly(symbols):
    return mixed(sum((x + 1) * pow(0xD6E8FEB86659FD93, k, 1 << 64) for k, x in enumerate(symbols)) & M64)


def shape_of(word):
    kinds = [1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b for b in word]
    return [k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k]


def brute_features(text, bits):
    words = text.split()
    hashes = [poly(w) for w in words]
    shapes = [(poly(shape_of(w)) + (i > 0 and hashes[i - 1] == hashes[i])) & M64 for i, w in enumerate(words)]
    grams = [
        set(hashes),
        {(3 * a + b) & M64 for a, b in zip(hashes, hashes[1:], strict=False)},
        {(a + 11) & M64 for a in shapes},
        {(7 * a + b) & M64 for a, b in zip(shapes, shapes[1:], strict=False)},
        {(5 * a + 3 * b + c + 13) & M64 for a, b, c in zip(shapes, shapes[1:], shapes[2:], strict=False)},
    ]
    return sorted({mixed((g + 101 * k) & M64) >> (64 - bits) for k, own in enumerate(grams) for g in own})


def brute_ftrl(rows, bits, epochs, alpha=0.5, beta=1.0, l1=0.02, l2=0.5):
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            values = {**dict.fromkeys(x, 1 / math.sqrt(max(1, len(x)))), 1 << bits: 1.0}
            ws = {i: weight(i) for i in values}
            error = 1 / (1 + math.exp(-sum(ws[i] * v for i, v in values.items()))) - y
            for i, v in values.items():
                g = error * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * ws[i]
                n[i] += g * g
    return {i: w for i in z if (w := weight(i))}


def test_features_and_updates_are_those_of_plain_python():
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(0, 40)) + rng.choice(["", " É3 É3 Ab-9", "  \n###"]) for _ in range(60)] + ["", "one", "one two"]
    rows = []
    for t in texts:
        x = classifier.features(t.encode(), 14)
        assert x.tolist() == brute_features(t.encode(), 14)
        rows.append((x, rng.randrange(2)))
    got = classifier.ftrl(rows, 14, epochs=3)
    want = brute_ftrl([(x.tolist(), y) for x, y in rows], 14, 3)
    assert {i: pytest.approx(w, abs=1e-5) for i, w in want.items()} == {int(i): float(got[i]) for i in np.flatnonzero(got)}
    model = classifier.Model(got, 14)
    for t, (x, _) in zip(texts, rows, strict=True):
        total = want.get(1 << 14, 0) + sum(want.get(i, 0) for i in x.tolist()) / math.sqrt(max(1, len(x)))
        assert model.score(t.encode()) == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_training_takes_one_label_and_text_an_id(spark):
    docs = table(spark, ["good words here"] * 2 + ["bad ### words"] * 2 + [None], ids=[0, 0, 3, 3, None])
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    assert model.score(b"good words here") > model.score(b"bad ### words")
    once = classifier.train(docs.dropDuplicates(["doc_id"]), spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int"))
    assert (model.weights == once.weights).all()


def test_every_stage_is_that_of_brute_force(spark):
    import corpus_pipeline

    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == columns and kept.dtypes == docs.dtypes
        rows = before.collect()
        if name == "quality":
            labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
            taught = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.text or "", labels[r.doc_id]) for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
            data = [(classifier.features(t.encode()), y) for _, t, y in taught]
            model = classifier.Model(classifier.ftrl(data))
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if model.score((r.text or "").encode()) >= 0.5}
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in rows])
            assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (x[2], len(x[2])) for i, x in want.items()}
        if name == "near_dedup":
            assert {r.doc_id for r in kept.collect()} == brute_copies([(r.doc_id, r.text) for r in rows])
        if name == "mixing":
            copies = {r.doc_id: r.mix_copies for r in mixing.mix(before).collect()}
            assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for i, n in copies.items() if n})
    pieces = corpus_pipeline.run(spark, SF).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in kept.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, len(ids)] += len(ids)
    got = Counter()
    for p in pieces:
        got[p.doc_id, p.doc_tokens] += p.length
    assert got == want
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def odd_documents(spark):
    """The columns of documents with nulls in each, repeats, empty and blank texts."""
    text = prose(random.Random(5), 80)
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " x", None, None, None), (2, None, "en", "a", 0), (3, "", None, None, 0), (4, " \n\n", "de", "b", 3), (5, "w" * 300_000, "en", "b", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and some.count() >= (0 if name == "quality" else 1)
        if name == "line_dedup":
            assert some.count() == docs.count()
        if name == "near_dedup":  # the repeat, the near copy without id and two of the three blank texts go
            assert sorted(r.doc_id for r in some.collect()) == [1, 2, 5]
        if name == "packing":
            assert {r.doc_id for r in some.collect()} == {None, 1, 2, 3, 4, 5}


# 1


def test_mixing_repeats_nulls_clashes_and_long_texts(spark):
    rows = [(7, "a b c", "s", 1)] * 5 + [(None, "d e", None, 2)] * 2 + [(8, "word " * 200_000, "t", 3), (9, None, "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies int")
    got = mixing.mix(docs).collect()
    assert {(r.doc_id, r.mix_size) for r in got} == {(7, 3), (None, 2), (8, 200_000), (9, 0)}
    assert all(len({r.mix_copies for r in got if r.doc_id == i}) == 1 for i in (7, None)) and max(r.mix_copies for r in got) <= 2


@pytest.mark.parametrize("most", [50_000, -1])
def test_mixing_is_near_its_targets_whatever_the_sizes(spark, monkeypatch, most):
    rng = random.Random(most)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rows = [(i, prose(rng, rng.choice([1, 2, 5, 30, 200])), rng.choice(["a", "b", "c", None]), 1) for i in range(900)] + [(2000 + k, prose(rng, 3000 >> k), "few", 1) for k in range(8)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, x int")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.mix_copies * r.mix_size
        target[r.source] = r.mix_target
    assert len(got) == len(rows)
    for s, t in target.items():
        assert abs(taken[s] - t) <= (0.05 if s == "few" else 0.02) * t


def test_a_document_is_drawn_with_the_chance_of_its_fraction(spark):
    """200 sources of the same 50 sizes stand for 200 seeds: ids, and so hashes, differ."""
    rng = random.Random(11)
    sizes = [max(1, round(rng.lognormvariate(4, 1))) for _ in range(50)]
    rows = [(1000 * k + i, "w " * n, f"s{k:03d}") for k in range(200) for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0,), share=1.3).collect()
    drawn, taken = Counter(), Counter()
    for r in got:
        assert r.mix_copies in (1, 2)
        drawn[r.doc_id % 1000] += r.mix_copies - 1
        taken[r.source] += r.mix_copies * r.mix_size
    assert all(abs(t - 1.3 * sum(sizes)) <= 0.02 * 1.3 * sum(sizes) for t in taken.values())
    chances = [drawn[i] / 200 for i in range(50)]
    assert all(abs(c - 0.3) <= 0.15 for c in chances)
    assert sum(abs(c - 0.3) for c in chances) / 50 < 0.05


# 3, 4, 5


def test_lines_clashing_columns_and_long_lines(spark):
    line = "x" * 200_000
    rows = [(i, line + "\n" + str(i), "k", 1, 2) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, n_lines int, n_dropped int")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.dedup_lines(docs).collect()}
    assert got == {i: (2, 1, str(i)) if i < 5 else (2, 0, line + "\n5") for i in range(6)}


def test_filters_are_sharded_by_their_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    rng = random.Random(2)
    pool = [prose(rng, 12) for _ in range(40)]
    rows = [(i, "\n".join(rng.sample(pool, 8))) for i in range(60)]
    docs = table(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    index = lines.LineIndex.build(docs)
    assert index.shards >= 8 and index.filters.count() > 4
    want = brute_lines(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in index.clean(docs).collect()} == want
    monkeypatch.setattr(lines, "BROADCAST_FILTERS", -1)
    passed, asked = index._candidates(docs), index._postings(docs)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in index.clean(docs).collect()} == want
    rare = docs.select("doc_id", classifier.F.concat("text", classifier.F.lit("\n"), classifier.F.md5("text"), classifier.F.lit(" and some more of it")).alias("text"))
    assert index._candidates(rare).count() < index._postings(rare).count() and passed.count() <= asked.count()


def test_substrings_clashing_columns_and_copies_across_rows(spark):
    rng = random.Random(6)
    part = prose(rng, 40)
    docs = spark.createDataFrame([(1, part, "c", 5), (2, "head " + part, "c", 5), (3, None, "c", 5)], "doc_id long, text string, kept_bytes string, n_removed int")
    got = {r.doc_id: (r.n_removed, bytes(r.kept_bytes)) for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: (0, part.encode()), 2: (len(part), b"head "), 3: (0, b"")}


def test_exact_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, "a"), (None, "a"), (5, "b"), (5, "b"), (6, "c"), (None, "c"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(None, None, 2, True)] * 2 + [(5, 5, 2, True)] * 2 + [(6, 6, 2, True), (None, 6, 2, False), (7, 8, 2, False), (8, 8, 2, True)])
    for low in (False, True):
        if low:
            monkeypatch.setattr(exact, "BROADCAST_LONGS", -1)
            monkeypatch.setattr("orrery.llm._work.HOT", 1)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()) == want


def test_chunks_follow_content_without_spaces(spark):
    rng = random.Random(7)
    own = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(6000))
    texts = [own, own[37:], "汉字文的是" * 900, ("汉字文的是" * 900)[3:]]
    made = [[c for c in r.c] for r in table(spark, texts).select(exact.chunks("text").alias("c")).collect()]
    assert ["".join(c) for c in made] == texts
    assert len(set(made[0]) & set(made[1])) >= 8  # the cuts meet again some way behind the start


# 6


def test_packing_long_texts_repeats_and_full_caches(spark, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    for name in ("CACHED_WORDS", "CACHED_PIECES"):
        monkeypatch.setattr(packing, name, 20)
    rng = random.Random(9)
    encode = packing.WordTokens(tokenizer_path())
    texts = [prose(rng, 50) + " Ünïque%d 漢字 x" % k for k in range(40)] + ["", "  "]
    for k in range(0, len(texts), 5):
        raw, at = encode(pa.array([x.encode() for x in texts[k : k + 5]], pa.binary()))
        ids = np.frombuffer(raw, "<u4")
        assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + 5]]
    monkeypatch.setattr(packing, "PORTION", 300)
    portions = list(packing._portions(list(range(len(texts))), pa.array([x.encode() for x in texts], pa.binary()), 300))
    assert b"".join(x for _, p, _ in portions for x in p.to_pylist()) == "".join(texts).encode()
    long = prose(rng, 30_000)
    docs = table(spark, [long, long, None, "a"], ids=[3, 3, None, None])
    got = Counter()
    for p in packing.pack(docs, tokenizer=tokenizer_path(), end=2).collect():
        got[p.doc_id] += p.length
    n = len(t.encode(long, add_special_tokens=False).ids) + 1
    assert got == {3: 2 * n, None: 1 + len(t.encode("a", add_special_tokens=False).ids) + 1}


# 7


def test_warc_takes_any_id_and_reads_what_it_wrote(spark, tmp_path):
    ids = ["a\r\nb", "", None, "%0A", "é>", " x"]
    pages = spark.createDataFrame([(i, "u", prose(random.Random(k), 200)) for k, i in enumerate(ids)], "page_id string, url string, html string")
    folder = f"file:{tmp_path}/archives"
    written = warc.write_archives(pages, folder, archive_bytes=200)
    got = warc.read_archives(spark, folder, written)
    assert Counter(r.page_id for r in got.collect()) == Counter(ids) and written.count() > 1
    stale = warc.ArchiveWriter()
    stale.add(warc.record("old", "u", b"left by a task that ran again", hashlib.sha256(b"left by a task that ran again").hexdigest()))
    (tmp_path / "archives" / f"part-000099-00000{warc.SUFFIX}").write_bytes(stale.data())
    assert got.count() == len(ids) and warc.read_archives(spark, folder).count() == len(ids) + 1
    again = spark.createDataFrame([(1, "u", "p" * 500_000), (2, "u", "p" * 500_000)], "page_id long, url string, html string")
    rows = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(again).collect()}
    assert rows == {"1": ("response", None, 500_000), "2": ("revisit", "1", 500_000)}


def test_warc_joins_many_digests_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", -1)
    monkeypatch.setattr("orrery.llm._work.HOT", 2)
    rows = [(i, "u", "x" * 200 if i < 5 else "y" * 200 if i < 7 else str(i) * 200) for i in range(10)]
    got = {r.page_id: r.refers_to for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {str(i): "0" if 0 < i < 5 else "5" if i == 6 else None for i in range(10)}


# 9, 10


def test_shards_are_written_and_read(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(120)] + [None]
    sharded = sharding.shard(table(spark, texts, ids=[*range(120), None]), limit=3000)
    sharding.write_shards(sharded, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter(r.text for r in back) == Counter(texts)
    size = Counter()
    for r in back:
        size[r.shard] += len((r.text or "").encode())
    assert len(size) > 2 and max(size.values()) <= 3000
    assert {("b" + r.shard, r.shard_bytes) for r in sharded.collect()} == set(size.items())


def test_rules_on_a_very_long_text(spark):
    text = "some words of a line that is long enough\n" * 20_000
    row = rules.judge(table(spark, [text]), report=True).first()
    assert (row.n_words, row.n_dup_lines, row.base_failed) == (180_000, 19_999, True)


def test_rules_without_report_stop_at_the_first_that_fails(spark):
    seen = Counter()

    def rule(name, verdict):
        return rules.Rule(name, lambda t: (seen.update([name]), verdict)[1])

    cascade = rules.Cascade([rule("never", False), rule("always", True)], sample=10)
    for _ in range(100):
        cascade.keeps(rules.Text(b"a b"))
    assert seen["never"] <= 12 and seen["always"] == 100
