"""The queries opN_<name>: each applies its operator, with production parameters, to its whole
table and derives the columns of its contract. SQL holds the same rows in ANSI SQL where SQL can
say them; the others are tested against brute force in tests/llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, exact, lines, mixing, neighbours, packing, ranking, rules, sharding, simhash, substrings, warc
from ._work import LOWER, UPPER, bounded_batches

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # see sources.tables.aligned_unions
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.round("mix_target", 6).alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer=tokenizer_path(), end=2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.round_trip(pages.select("page_id", "url", "html")).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return classifier.score(docs, model).select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard", "shard_bytes", "fits")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, report=True).select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.neighbours(vectors, F.pmod("vec_id", F.lit(50)) == 0)


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = ranking.index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranking.search(shards, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_lines, op4_substrings, op5_exact, op6_packing, op7_warc, op8_classifier, op9_sharding, op10_rules, op11_neighbours, op12_ranking)}

SQL = {
    "op1_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s
), p AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM r
), l AS (SELECT min_by((budget - below) / w_left, k) AS level FROM p WHERE w * ((budget - below) / w_left) < cap),
t AS (SELECT source, source_size, least(cap, w * level) AS target FROM p, l),
u AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS whole,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END - floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS fraction,
         CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':17'), 1, 13) AS BIGINT) AS x, CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':17'), 14, 13) AS BIGINT) | 1 AS step
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (SELECT u.*, trial, (x + trial * step) & 4503599627370495 < fraction * 4503599627370496.0::DOUBLE AS again FROM u, (SELECT unnest(range({mixing.TRIES})) AS trial)),
g AS (SELECT source, trial, abs(any_value(whole * source_size) + sum(CASE WHEN again THEN size ELSE 0 END) - any_value(target)) AS gap, any_value(target) AS target FROM n GROUP BY source, trial),
c AS (SELECT source, coalesce(min(trial) FILTER (WHERE gap <= {mixing.NEAR} * target), arg_min(trial, (gap, trial))) AS trial FROM g GROUP BY source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST((whole + CASE WHEN again THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source AND n.trial = c.trial""",
    "op3_lines": r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT n, doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT n) >= 5
), m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY n, doc_id""",
    "op5_exact": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op9_sharding": f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM documents
), b AS (
  SELECT depth, h >> (52 - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM d, (SELECT unnest(range(53)) AS depth) GROUP BY ALL HAVING sum(n_bytes) <= {sharding.LIMIT} OR depth = 52
), l AS (
  SELECT doc_id, n_bytes, h, min(depth) AS depth FROM d JOIN b ON h >> (52 - depth) = prefix GROUP BY doc_id, n_bytes, h
)
SELECT doc_id, n_bytes, CASE WHEN l.depth = 0 THEN '' ELSE left(lpad(bin(h), 52, '0'), CAST(l.depth AS INTEGER)) END AS shard, shard_bytes, shard_bytes <= {sharding.LIMIT} AS fits
FROM l JOIN b ON l.depth = b.depth AND l.h >> (52 - l.depth) = b.prefix""",
    "op10_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), b AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d
), g AS (
  SELECT doc_id, i, {" || chr(32) || ".join(f"lead(word, {k}) OVER v" if k else "word" for k in range(8))} AS gram FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), h AS (
  SELECT doc_id, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS often FROM g
), c AS (
  SELECT doc_id, max(often) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM h
), r AS (
  SELECT doc_id, sum(covered) AS n FROM c GROUP BY doc_id
), s AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM b LEFT JOIN r USING (doc_id)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f""",
    "op12_ranking": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(text, '{TERM}'), lambda x: translate(x, '{UPPER}', '{LOWER}')) AS ts FROM documents
), s AS (SELECT count(*) AS n_all, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
i AS (
  SELECT DISTINCT item_id, text, unnest(list_transform(regexp_extract_all(text, '{TERM}'), lambda x: translate(x, '{UPPER}', '{LOWER}'))) AS term
  FROM benchmark
), w AS (
  SELECT item_id, text, i.term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN df ON i.term = df.term, s
), c AS (
  SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l)))) AS BIGINT) AS score
  FROM f JOIN w ON f.term = w.term, s GROUP BY item_id, text, r, doc_id
), o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10""",
}
