"""The operators of orrery.llm against brute force, on small tables with nulls, empty and blank
texts, ties, repeated rows and columns whose names clash with results."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from orrery.llm import classifier, exact, lines, links, mixing, packing, rules, sharding, simhash, substrings, warc
from orrery.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORDS = "the of and rain stone river light cloud over under with green small winter harbour lantern".split()
SCHEMA = "doc_id long, text string, source string, size int, fp string, kept boolean, shard string, score string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, ids=None, sources=None):
    """Rows with extra columns named like results."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["a"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, s, 1, "x", None, "s", "q") for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "One", "a b c", "a b c\n"]
    shared = prose(rng, 30)
    for _ in range(n):
        t = prose(rng, rng.choice([3, 25, 80, 200]))
        if rng.random() < 0.4:
            t = t[: len(t) // 2] + "\n" + shared + "\n" + t[len(t) // 2 :]
        texts.append(t)
        if rng.random() < 0.3:
            words = t.split(" ")
            words[rng.randrange(len(words))] = "é€x"
            texts.append(" ".join(words))
        if rng.random() < 0.2:
            texts.append(t)
    return texts


# 1


def test_mixing_targets_and_copies(spark):
    rng = random.Random(1)
    sources = [rng.choice(["b", "a", "c", "é", None]) for _ in range(400)]
    texts = [None if rng.random() < 0.05 else prose(rng, rng.randrange(0, 30)) for _ in sources]
    rows = mixing.mix(table(spark, texts, sources=sources)).collect()
    size = Counter()
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:  # share, cap, share again
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        level = left / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level >= 2 * size[s]}
        if not more:
            break
        capped |= more
    want = {s: 2 * size[s] if s in capped else weight[s] * level for s in order}
    taken = Counter()
    for r in rows:
        assert r.mix_source_size == size[r.source] and r.mix_target == pytest.approx(want[r.source])
        rate = want[r.source] / size[r.source]
        assert r.mix_copies in (int(rate), int(rate) + 1) and r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
    for s in order:
        assert taken[s] == pytest.approx(want[s], rel=0.02)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table(spark, texts, sources=sources)).collect()))
    emitted = mixing.emit(mixing.mix(table(spark, texts, sources=sources)))
    assert emitted.columns == table(spark, []).columns and emitted.count() == sum(r.mix_copies for r in rows)


def test_mixing_empty(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r.mix_copies for r in mixing.mix(table(spark, [None, ""])).collect()] == [0, 0]


# 2


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    bits = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_groups(spark):
    texts = corpus()
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(table(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = classes(near, range(len(texts)))
    assert got == {i: (fps[i], want[i]) for i in want}


@pytest.mark.parametrize("most", [4096, 3])
def test_links_of_close_fingerprints_are_whole(spark, most):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for b in list(fps)[:8]:
        for _ in range(30):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 7))))
    fps = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    near = [(a, b) for a in fps for b in fps if a > b and ((a ^ b) % (1 << 64)).bit_count() <= 4]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in links.components(simhash.hamming_links(df, most=most)).collect()}
    want = classes(near, fps)
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_a_chain_with_a_hub(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)}


def test_keep_one_repeats_and_nulls(spark):
    long = prose(random.Random(3), 60)
    docs = table(spark, [long, long, long, "other words here now", "other words here now", None, ""], ids=[4, 4, None, 9, 9, 7, None])
    left = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert left == sorted([("4", long), ("9", "other words here now"), ("7", None)])
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.keep_one(table(spark, [])).count() == 0


# 3


def brute_lines(rows, least=40, most=5):
    key = lambda x: re.sub(rb"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", b"", x.encode()).lower()
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x).decode()) >= least:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        all_ = (t or "").split("\n")
        stay = [x for x in all_ if not (len(holders.get(key(x), ())) >= most and i != max(holders[key(x)]))]
        out[i] = (len(all_), len(all_) - len(stay), "\n".join(stay))
    return out


def line_rows(seed=4):
    rng = random.Random(seed)
    pool = [prose(rng, 9) for _ in range(6)] + ["é" * 39, "É" * 40, "x" * 39 + "\x1f"]
    rows = []
    for i in range(40):
        t = [rng.choice(["", "  ", "\t"]) + rng.choice([x, x.upper()]) + rng.choice(["", " \r"]) for x in rng.sample(pool, 4)]
        rows.append((i, "\n".join(t + [prose(rng, 12)] * rng.randrange(3))))
    return rows + [(50, None), (51, ""), (52, "\n\n")]


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()}


def test_line_dedup(spark, monkeypatch):
    rows = line_rows()
    docs = table(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    assert result(lines.dedup_lines(docs)) == brute_lines(rows)
    monkeypatch.setattr(lines, "BROADCAST_FILTERS", -1)
    monkeypatch.setattr(lines, "BROADCAST_HITS", -1)
    assert result(lines.dedup_lines(docs, shards=3)) == brute_lines(rows)
    assert lines.dedup_lines(table(spark, [])).count() == 0


def test_line_index_inserts_and_deletes(spark):
    rows = line_rows()
    docs = lambda part: table(spark, [t for _, t in part], ids=[i for i, _ in part])
    index = lines.LineIndex.build(docs(rows[:15]), shards=2)
    index = index.insert(docs(rows[15:]))
    assert result(index.clean(docs(rows))) == brute_lines(rows)
    gone = {i for i, _ in rows[20:40]}
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert result(index.clean(docs(left))) == brute_lines(left)
    index = index.insert(docs([r for r in rows if r[0] in gone]))
    assert result(index.clean(docs(rows))) == brute_lines(rows)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2)
    f = lines.CuckooFilter.for_keys(len(keys))
    assert all(f.insert(int(k)) for k in keys) and f.contains(keys).all()
    assert lines.CuckooFilter.load(f.dump()).contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, 20000, np.uint64) * np.uint64(2) + np.uint64(1)).mean() < 0.01
    assert all(f.delete(int(k)) for k in keys[:2000])
    assert f.contains(keys[2000:]).all() and f.contains(keys[:2000]).mean() < 0.01


# 4


def brute_repeats(rows, size):
    seen, out = set(), {}
    for i, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(b[p : p + size])
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("size", "q", "wide"), [(100, 40, 8192), (100, 40, 2), (32, 12, 8192)])
def test_substrings(spark, size, q, wide):
    rng = random.Random(6)
    texts = corpus(7, 40) + ["ab" * 150, "a" * 400, "b" + "a" * 250, prose(rng, 4000)]
    texts += [texts[-1][1000:1400] + "x" + texts[-1][2000:2099], "é" * 120]
    docs = table(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in substrings.remove_repeats(docs, length=size, q=q, wide=wide).collect()}
    assert got == brute_repeats(list(enumerate(texts)), size)


def test_substrings_repeated_and_null_ids(spark):
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = table(spark, [a, a, a + b, b, b, ""], ids=[1, 1, 1, None, 5, None])
    got = Counter((str(r.doc_id), r.text, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    x, y = len(a), len(b)
    assert got[("5", b, y)] == 1 and got[("None", b, y)] == 1
    first_is_a = got[("1", a, 0)] == 2 and got[("1", a + b, x)] == 1  # one id, two texts: either may come first
    assert first_is_a or got[("1", a, x)] == 2 and got[("1", a + b, 0)] == 1
    assert substrings.remove_repeats(table(spark, [])).count() == 0


def test_long_text_has_the_same_anchors(monkeypatch):
    text = prose(random.Random(9), 3000).encode()
    whole = substrings.anchors(text, substrings.Shape())
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    cut = substrings.anchors(text, substrings.Shape())
    assert all((x == y).all() for x, y in zip(whole, cut, strict=True))
    assert np.diff(whole[0]).max() <= 61


# 5


def test_exact_groups(spark, monkeypatch):
    texts = corpus() + [prose(random.Random(3), 3000)] * 3 + ["a b c"]
    for clash in (False, True):
        if clash:  # all chunks share a few hashes: identifiers must be told apart by content
            real = exact.F.xxhash64
            monkeypatch.setattr(exact.F, "xxhash64", lambda *c: real(*c) % 3)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(table(spark, texts)).collect()}
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            groups[t or ""].append(i)
        want = {}
        for t, ids in groups.items():
            for i in ids:
                want[i] = (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
        assert got == want
    assert exact.exact_groups(table(spark, [])).count() == 0


def test_chunks_are_the_whole_text(spark):
    texts = ["", "e \n" * 500, "é" * 9000, "\n" * 5000, "𝒳e " * 700, prose(random.Random(2), 900)]
    for r in table(spark, texts).select("text", exact.chunks("text").alias("c")).collect():
        assert "".join(r.c) == r.text and all(len(c) <= 4096 for c in r.c)


# 6


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(11)
    texts = corpus() + [prose(rng, 9000), "it's 'S x'Ré 1234 ½ Œuvre İx á <|endoftext|>ab ΑΣ ſt"] + ["word"] * 3
    docs = table(spark, texts).repartition(3)
    pieces = packing.pack(docs, tokenizer=tokenizer_path(), end=2, open_windows=4, length=512).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids[i])
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) <= 512
    padding = sum(512 - n for own in by_sequence.values() if (n := sum(p.length for p in own)) & (n - 1))
    assert padding <= 0.05 * sum(map(len, ids.values()))
    assert packing.pack(table(spark, []), tokenizer=tokenizer_path(), end=2).count() == 0


# 7


def test_warc_round_trip(spark):
    big = "<p>" + prose(random.Random(1), 50) + "</p>"
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        r, raw = got[None if i is None else str(i)], (html or "").encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        first = {2: "1", None: "1", 8: "7"}.get(i)
        assert (r.record_type, r.refers_to) == (("revisit", first) if first else ("response", None))
        assert (bytes(r.payload) if r.payload is not None else None) == (None if first else raw)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_archive_and_faults():
    writer, raws = warc.ArchiveWriter(), []
    for k in range(500):
        payload = (prose(random.Random(k % 50), 60) + str(k)).encode()
        raws.append(warc.record(k, f"http://h/{k}", payload, hashlib.sha256(payload).hexdigest()))
        writer.add(raws[-1])
    data = writer.data()
    got = list(warc.read_archive(data, step=100))
    assert [r.headers["warc-record-id"] for r in got] == [f"<urn:x-page:.{k}>" for k in range(500)]
    assert len(data) < 0.6 * sum(map(len, raws))
    assert data[:4] == bytes.fromhex("5d2a4d18")
    for bad in (data[:-3], b"\0" + data[1:], data[:4], data[:3000] + b"\1\2\3" + data[3003:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    for bad in (raws[0] + b"x", raws[0].replace(b"WARC/1.1", b"WARC/9"), raws[0].replace(b"Content-Length", b"Content-Size"), raws[0].replace(b"the", b"teh", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


# 8


def test_classifier_learns_and_holds_out(spark):
    rng = random.Random(12)
    texts, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        t = prose(rng, 40) if good else " ".join(w + rng.choice(["###", "!!", "***"]) for w in prose(rng, 30).split())
        texts.append(t)
        labels.append((i, int(good)))
    texts += [None, "", "\n"]
    docs = table(spark, texts)
    labelled = spark.createDataFrame([*labels, (5000, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = classifier.train(docs, labelled)
    rows = {r.doc_id: r for r in classifier.score(docs, model).withColumn("ho", classifier.held_out(classifier.F.col("doc_id"))).collect()}
    assert {i: r.ho for i, r in rows.items()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))}
    held = [(rows[i].score, y) for i, y in labels if rows[i].ho]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    assert rows[900].score == rows[901].score == rows[902].score and 0 <= rows[900].score <= 1
    flipped = [(i, y if rows[i].ho is False else 1 - y) for i, y in labels]  # held-out labels change nothing
    again = classifier.train(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    assert (again.weights == model.weights).all()
    none = classifier.train(docs, labelled.limit(0))
    assert not none.weights.any()
    assert classifier.score(table(spark, []), model).count() == 0


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    text = (prose(random.Random(13), 2000) + " ÉÀ 123 x-y").encode()
    whole = classifier.features(text)
    monkeypatch.setattr(classifier, "SEGMENT", 501)
    assert (classifier.features(text) == whole).all()
    assert (classifier.features(b"x" * 5000 + b" y") == classifier.features(b" " + b"x" * 5000 + b"\ny")).all()


# 9


def brute_shards(sizes, limit):
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) for i in sizes}
    out = {}

    def split(ids, prefix):
        total = sum(sizes[i] for i in ids)
        if total <= limit or len(prefix) == 52:
            out.update((i, (prefix, total)) for i in ids)
            return
        for bit in "01":
            own = [i for i in ids if f"{h[i]:052b}"[len(prefix)] == bit]
            if own:
                split(own, prefix + bit)

    split(list(sizes), "")
    return out


def test_sharding(spark, monkeypatch):
    rng = random.Random(14)
    texts = ["x" * rng.randrange(50) for _ in range(300)] + ["y" * 900, None]
    want = brute_shards({i: len(t or "") for i, t in enumerate(texts)}, 1000)
    for step in (18, 3):
        monkeypatch.setattr(sharding, "FIRST", step)
        monkeypatch.setattr(sharding, "STEP", step)
        got = {r.doc_id: r for r in sharding.shard(table(spark, texts), limit=1000).collect()}
        assert {i: (r.shard, r.shard_bytes) for i, r in got.items()} == want and all(r.fits for r in got.values())
    assert sharding.shard(table(spark, [])).count() == 0


def test_sharding_one_key_too_large(spark):
    docs = table(spark, ["x" * 400] * 5 + ["z"], ids=[7] * 5 + [8])
    rows = sharding.shard(docs, limit=1000).collect()
    assert {(r.doc_id, r.fits) for r in rows} == {(7, False), (8, True)}
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1 and {r.shard_bytes for r in rows} == {2000, 1}


# 10


def test_rules(spark):
    rng = random.Random(15)
    texts = corpus() + ["w " * 40, prose(rng, 30) + " # $ %" * 10, "line one here\n" * 6 + prose(rng, 40), "é " * 25, prose(rng, 12) + " " + prose(rng, 9) * 2]
    got = {r.doc_id: r for r in rules.judge(table(spark, texts), report=True, sample=7).collect()}
    short = {r.doc_id: r.kept for r in rules.judge(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        n = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(8)}
        own = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(own) - len(set(own)), len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert r.kept == short[i] and not (r.kept and r.base_failed)
    assert rules.judge(table(spark, []), report=True).count() == 0


def test_cascade_orders_by_rejection_per_cost():
    slow = rules.Rule("slow", lambda t: sum(range(20000)) < 0)
    quick = rules.Rule("quick", lambda t: t.n_words < 5)
    cascade = rules.Cascade([slow, quick], sample=20)
    assert [cascade.keeps(rules.Text(b"a b")) for _ in range(20)] == [False] * 20
    assert cascade.rules[0].name == "quick" and not cascade.keeps(rules.Text(b"a")) and cascade.keeps(rules.Text(b"a b c d e"))
