"""The jobs as queries: each runs its job twice over the whole tables into one new folder of the session's
checkpoint folder, and returns what the second run left there. SQL holds the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import layer_campaign, text_screen
from orrery.operators.graph import checkpoints
from orrery.registry import POINTS

ROUNDED = ("auc", "delta", "label_draw_q95", "stratum_draw_q95", "p_upper", "strict_margin")


def _shown(results: DataFrame, *keys: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ROUNDED]
    return results.select(*keys, "hypothesis", "n_positive", "n_negative", *rounded, "strict_positive")


def job1_layer_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{checkpoints(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        results = layer_campaign.run(spark, f"{sf_dir}/embeddings.parquet", out)
    return _shown(results, "domain", "split", "layer")


def job2_text_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoints(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        results = text_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/screen", f"{folder}/mark")
    return _shown(results, "lang", "half")


def _drawn(source: str, row: str, keys: list[str], scores: list[str], replicates: int) -> str:
    """SQL of a drawn screen's verdicts over a table with columns y and stratum."""
    k = ", ".join(keys)
    same = lambda a, b, on: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in on)
    draw = lambda kind, rate: f"CASE WHEN perm_idx < 0 THEN y WHEN CAST('0x' || substr(md5({row} || '|' || perm_idx || '|{kind}'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < {rate} THEN 1 ELSE 0 END"
    by = [*keys, "hypothesis"]
    return f"""
rate AS (SELECT *, CAST(sum(y) OVER (PARTITION BY {k}) AS DOUBLE) / count(*) OVER (PARTITION BY {k}) AS r, CAST(sum(y) OVER (PARTITION BY {k}, stratum) AS DOUBLE) / count(*) OVER (PARTITION BY {k}, stratum) AS rs FROM {source}),
drawn AS (SELECT *, {draw("label_draw", "r")} AS label_draw, {draw("stratum_draw", "rs")} AS stratum_draw FROM rate, (SELECT unnest(range(-1, {replicates})) AS perm_idx)),
long AS ({" UNION ALL ".join(f"SELECT {k}, '{h}' AS hypothesis, perm_idx, null_kind, {h} AS score, p FROM (SELECT *, 'label_draw' AS null_kind, label_draw AS p FROM drawn UNION ALL SELECT *, 'stratum_draw', stratum_draw FROM drawn) WHERE {h} IS NOT NULL" for h in scores)}),
counted AS (SELECT {k}, hypothesis, perm_idx, null_kind, score, sum(p) AS p, count(*) AS n FROM long GROUP BY ALL),
won AS (SELECT *, p * (coalesce(sum(n - p) OVER (PARTITION BY {k}, hypothesis, perm_idx, null_kind ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n - p) / 2.0::DOUBLE) AS w FROM counted),
aucs AS (SELECT {k}, hypothesis, perm_idx, null_kind, CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(n - p) AS BIGINT) AS n_negative,
  CASE WHEN sum(p) > 0 AND sum(n - p) > 0 THEN CAST(sum(w) AS DOUBLE) / CAST(sum(p) * sum(n - p) AS DOUBLE) END AS auc FROM won GROUP BY ALL),
seen AS (SELECT *, abs(auc - 0.5) AS delta FROM aucs WHERE perm_idx < 0 AND null_kind = 'label_draw'),
nulls AS (SELECT *, abs(auc - 0.5) AS null_value FROM aucs WHERE perm_idx >= 0),
cuts AS (SELECT {k}, hypothesis, quantile_cont(null_value, 0.95) FILTER (WHERE null_kind = 'label_draw') AS label_draw_q95, quantile_cont(null_value, 0.95) FILTER (WHERE null_kind = 'stratum_draw') AS stratum_draw_q95 FROM nulls GROUP BY ALL),
tails AS (SELECT {", ".join("s." + c for c in by)}, (1.0 + count(*) FILTER (WHERE null_value >= delta)) / (1 + count(null_value)) AS p_upper FROM nulls n JOIN seen s ON {same("n", "s", by)} GROUP BY ALL)
SELECT {", ".join("s." + c for c in by)}, n_positive, n_negative, round(auc, 6) AS auc, round(delta, 6) AS delta, round(label_draw_q95, 6) AS label_draw_q95, round(stratum_draw_q95, 6) AS stratum_draw_q95,
  round(p_upper, 6) AS p_upper, round(delta - greatest(label_draw_q95, stratum_draw_q95), 6) AS strict_margin, CASE WHEN delta - greatest(label_draw_q95, stratum_draw_q95) > 1e-9 THEN 1 ELSE 0 END AS strict_positive
FROM seen s LEFT JOIN cuts c ON {same("s", "c", by)} LEFT JOIN tails t ON {same("s", "t", by)}"""


QUERIES = {f.__name__: f for f in (job1_layer_campaign, job2_text_screen)}

SQL = {
    "job1_layer_campaign": f"""
WITH {POINTS}, nodes AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS spot FROM embeddings), aimed AS (
  SELECT vec_id AS a, CAST('0x' || substr(md5(vec_id || '|' || draw || '|edge'), 1, 13) AS BIGINT) % (SELECT count(*) FROM nodes) AS spot FROM nodes, (SELECT unnest(range(8)) AS draw)),
partner AS (SELECT DISTINCT least(a, vec_id) AS u, greatest(a, vec_id) AS v FROM aimed JOIN nodes USING (spot) WHERE a <> vec_id),
far AS (
  SELECT p.u, p.v, CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS y, x.label % 3 AS domain, x.layer, CAST(round(1000 * list_distance(x.vec, y.vec)) AS BIGINT) AS d,
    CAST(round(1000 * list_cosine_similarity(x.vec, y.vec)) AS BIGINT) AS cosine, -CAST(round(1000 * abs(sqrt(list_dot_product(x.vec, x.vec)) - sqrt(list_dot_product(y.vec, y.vec)))) AS BIGINT) AS norms
  FROM partner p JOIN points x ON p.u = x.vec_id JOIN points y ON p.v = y.vec_id AND x.layer = y.layer),
med AS (SELECT quantile_cont(u, 0.5) AS mu, quantile_cont(v, 0.5) AS mv FROM far),
split AS (SELECT 'source_disjoint' AS split, far.* FROM far, med WHERE u <= mu UNION ALL SELECT 'target_disjoint', far.* FROM far, med WHERE v > mv UNION ALL SELECT 'dual_axis', far.* FROM far, med WHERE u <= mu AND v > mv),
q AS (SELECT domain, split, layer, quantile_cont(CAST(d AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM split GROUP BY ALL),
edges AS (SELECT u || '-' || v AS edge, y, s.domain, s.split, s.layer, -d AS distance, cosine, norms, CAST(d > q[1] AS INTEGER) + CAST(d > q[2] AS INTEGER) + CAST(d > q[3] AS INTEGER) AS stratum
  FROM split s JOIN q ON s.domain = q.domain AND s.split = q.split AND s.layer = q.layer),
{_drawn("edges", "edge", ["domain", "split", "layer"], ["distance", "cosine", "norms"], 20)}""",
    "job2_text_screen": rf"""
WITH d AS (
  SELECT doc_id, lang, source, CAST(CAST('0x' || substr(md5(doc_id || '|half'), 1, 13) AS BIGINT) % 2 AS INTEGER) AS half, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{text_screen.WORD}') AS ws FROM documents
), c AS (SELECT *, len(ws) AS n, length(array_to_string(ws, '')) AS chars FROM d),
docs AS (
  SELECT c.doc_id, lang, half, CAST(l.quality > 0 AS INTEGER) AS y, source AS stratum, n AS words, 100 * chars // nullif(n, 0) AS word_length, 1000 * len(list_distinct(ws)) // nullif(n, 0) AS distinct_words,
    1000 * length(regexp_replace(t, '[^0-9]', '', 'g')) // nullif(chars, 0) AS digits, 1000 * length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) // nullif(chars, 0) AS symbols
  FROM c JOIN labels l ON c.doc_id = l.doc_id WHERE l.quality IS NOT NULL
),
{_drawn("docs", "doc_id", ["lang", "half"], list(text_screen.NAMES), 20)}""",
}
