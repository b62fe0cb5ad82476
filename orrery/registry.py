"""Where queries are registered, with pieces of SQL that several share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def load() -> None:
    """Import the modules that register queries."""
    for name in ("queries", "descriptor_queries"):
        importlib.import_module(f"orrery.{name}")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# shared pieces of SQL

POINTS = """points AS (
  SELECT vec_id, label, label % 3 AS domain, l AS layer, list_transform(embedding[1 + 16 * l : 16 + 16 * l], lambda x: CAST(x AS DOUBLE)) AS vec
  FROM embeddings, (SELECT CAST(unnest(range(4)) AS INTEGER) AS l))"""
KNN = POINTS + """, knn AS (
  SELECT * FROM (
    SELECT a.layer, a.vec_id AS id, b.vec_id AS neighbour, list_distance(a.vec, b.vec) AS distance,
           row_number() OVER (PARTITION BY a.layer, a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS rank
    FROM points a JOIN points b ON a.layer = b.layer AND a.vec_id <> b.vec_id) WHERE rank <= 8),
knn_edges AS (SELECT layer, least(id, neighbour) AS u, greatest(id, neighbour) AS v, min(distance) AS distance FROM knn GROUP BY ALL)"""
TRADE = """trade AS (
  SELECT c.c_nationkey AS source, s.s_nationkey AS target, count(*) AS w
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY ALL),
top AS (SELECT source, target, w FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w DESC, target) AS r FROM trade WHERE source <> target) WHERE r <= 6),
und AS (SELECT DISTINCT least(source, target) AS u, greatest(source, target) AS v FROM top),
both_ways AS (SELECT u AS a, v AS b FROM und UNION ALL SELECT v, u FROM und),
deg AS (SELECT a AS node, count(*) AS degree FROM both_ways GROUP BY a)"""
TERMS = """terms AS (
  SELECT symbol, term FROM (
    SELECT l_suppkey AS symbol, p_brand AS term, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_brand) AS r
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand) WHERE r <= 6)"""
SCORED = "scored AS (SELECT d.doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars, quality, toxic FROM documents d JOIN labels l USING (doc_id))"
TOKENS = """tokens AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS token FROM events),
steps AS (SELECT user_id, pos, token, h1, h2 FROM (SELECT *, lag(token) OVER w AS h1, lag(token, 2) OVER w AS h2 FROM tokens WINDOW w AS (PARTITION BY user_id ORDER BY pos)))"""
AUC = """sum((p * (coalesce(below, 0) + (n - p) / 2.0))) / (sum(p) * sum(n - p))"""


def auc_sql(source: str, keys: str, label: str, score: str) -> str:
    """AUC by Mann-Whitney ranks, another way than counts by score."""
    return f"""
    SELECT {keys}, CASE WHEN sum({label}) > 0 AND sum({label}) < count(*) THEN
             (sum(CASE WHEN {label} > 0 THEN auc_rank END) - sum({label}) * (sum({label}) + 1) / 2.0) / (sum({label}) * (count(*) - sum({label}))) END AS auc
    FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0 AS auc_rank FROM {source})
    GROUP BY {keys}"""
