"""Queries of the descriptors of trajectories, nodes and modules, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expressions as X
from .functions import stats as S
from .operators import descriptors as D
from .operators import graph, models, vectors
from .plans import audit
from .registry import KNN, POINTS, SCORED, TRADE, auc_sql, query, r6
from .sources import tables as T

KNN14 = KNN.replace("rank <= 8)", "rank <= 14)")


def _spectrum_sql(t: str, suffix: str = "") -> str:
    """Columns of derivative_spectrum() of a list t of doubles with two entries or more."""
    d1 = f"list_transform(range(1, len({t})), lambda i: {t}[i + 1] - {t}[i])"
    size = f"list_transform({d1}, lambda x: abs(x))"
    mass = f"greatest(list_sum({size}), 1e-8)"
    d2 = f"list_transform(range(1, len({t}) - 1), lambda i: abs({t}[i + 2] - 2 * {t}[i + 1] + {t}[i]))"
    over = f"list_transform({t}, lambda x: x > 0.5)"
    made = {
        "area": f"list_avg({t})", "onset": f"(CASE WHEN list_contains({over}, true) THEN list_position({over}, true) - 1 ELSE len({t}) END) / (len({t}) - 1)",
        "rise": f"{t}[len({t})] - {t}[1]", "entropy": f"-list_sum(list_transform({size}, lambda a: a / {mass} * ln(greatest(a / {mass}, 1e-8)))) / ln(greatest(len({t}) - 1, 2))",
        "step": f"list_avg({d1})", "step_abs": f"list_avg({size})", "peak": f"(list_position({size}, list_max({size})) - 1) / greatest(len({t}) - 2, 1)", "bend": f"list_avg({d2})",
    }
    return ", ".join(f"{v} AS {k}{suffix}" for k, v in made.items())


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"WITH {POINTS}, s AS (SELECT vec_id, layer, {_spectrum_sql('vec')} FROM points) SELECT vec_id, layer, {_rounded(D.SPECTRUM)} FROM s")
def derivative_spectrum(spark, sf):
    return T.points(spark, sf).select("vec_id", "layer", *[F.round(c, 6).alias(k) for k, c in D.derivative_spectrum("vec").items()])


_GAPS = ", ".join(f"{k}_2 - {k}_1 AS {k}_gap" for k in D.CONTRASTED)
_CONTRAST = [f"{k}_{i}" for i in (1, 2) for k in D.SPECTRUM] + [f"{k}_gap" for k in D.CONTRASTED]


@query(f"""WITH {POINTS}, p AS (SELECT a.vec_id, a.layer, a.vec AS t1, b.vec AS t2 FROM points a JOIN points b ON a.vec_id = b.vec_id AND a.layer + 1 = b.layer),
s AS (SELECT vec_id, layer, {_spectrum_sql('t1', '_1')}, {_spectrum_sql('t2', '_2')} FROM p), g AS (SELECT *, {_GAPS} FROM s) SELECT vec_id, layer, {_rounded(_CONTRAST)} FROM g""")
def spectrum_contrast(spark, sf):
    p = T.points(spark, sf)
    both = p.select("vec_id", "layer", F.col("vec").alias("t1")).join(p.select("vec_id", (F.col("layer") - 1).alias("layer"), F.col("vec").alias("t2")), ["vec_id", "layer"])
    return both.select("vec_id", "layer", *[F.round(c, 6).alias(k) for k, c in D.spectrum_contrast("t1", "t2").items()])


@query(f"""WITH {POINTS}, s AS (SELECT vec_id, layer, vec, list_avg(vec) AS level, list_transform(range(1, 16), lambda i: vec[i + 1] - vec[i]) AS d1 FROM points),
g AS (SELECT vec_id, layer, level, list_sum(list_transform(range(1, 17), lambda i: (i - 8.5) / 16 * (vec[i] - level))) / (340.0 / 256) AS slope,
  list_avg(list_transform(d1, lambda x: abs(x))) AS roughness, list_avg(list_transform(range(1, 15), lambda i: abs(d1[i + 1] - d1[i]))) AS curvature,
  CAST(len(list_filter(range(1, 15), lambda i: sign(d1[i + 1]) * sign(d1[i]) < 0)) AS DOUBLE) AS crossings, list_max(vec) - list_min(vec) AS span, vec[16] - vec[1] AS rise FROM s)
SELECT vec_id, layer, {_rounded(D.VINEYARD)} FROM g""")
def vineyard(spark, sf):
    return T.points(spark, sf).select("vec_id", "layer", *[F.round(c, 6).alias(k) for k, c in D.vineyard("vec", [k / 16 for k in range(16)]).items()])


@query(f"""WITH {POINTS}, n AS (SELECT label, layer, avg(sqrt(list_sum(list_transform(vec, lambda x: x * x)))) AS d FROM points GROUP BY ALL),
w AS (SELECT label, max(CASE WHEN layer = 0 THEN d END) AS d0, max(CASE WHEN layer = 1 THEN d END) AS d1, max(CASE WHEN layer = 2 THEN d END) AS d2, max(CASE WHEN layer = 3 THEN d END) AS d3 FROM n GROUP BY label)
SELECT label, CAST(d1 > d0 AND d2 > d1 AND d3 >= d2 - 0.003 AS INTEGER) AS hit FROM w""")
def layer_motif_hits(spark, sf):
    n = T.points(spark, sf).groupBy("label", "layer").agg(F.avg(X.norm("vec")).alias("d"))
    at = lambda k: F.max(F.when(F.col("layer") == k, F.col("d")))
    w = n.groupBy("label").agg(*[at(k).alias(f"d{k}") for k in range(4)])
    return w.select("label", D.rises_then_holds(*[F.col(f"d{k}") for k in range(4)]).alias("hit"))


@query(f"""WITH {SCORED}, m AS (SELECT *, avg(n_chars) OVER (PARTITION BY source) AS mu, stddev_samp(n_chars) OVER (PARTITION BY source) AS sd FROM scored)
SELECT source, round(CASE WHEN count(*) < 3 THEN NULL WHEN any_value(sd) <= 1e-12 THEN 0.0 ELSE avg(((n_chars - mu) / sd) ** 3) END, 6) AS skew FROM m GROUP BY source""")
def sample_skew(spark, sf):
    return T.scored_documents(spark, sf).groupBy("source").agg(D.sample_skew("n_chars").alias("skew")).select("source", *r6("skew"))


def _mle(a: str, b: str) -> str:
    """The estimate from the ranks a to b of near, a list in order of rank."""
    xs = f"near[{a} : {b}]"
    return (f"least(200.0, greatest(0.1, (len({xs}) - 1) / greatest(list_sum(list_transform({xs}[1 : len({xs}) - 1], lambda x: ln(greatest({xs}[len({xs})] / x, 1 + 1e-8)))), 1e-8)))")


@query(f"""WITH {KNN14}, g AS (SELECT layer, id, list(greatest(distance, 1e-8) ORDER BY rank) AS near FROM knn GROUP BY ALL)
SELECT layer, id, round({_mle('1', '4')}, 5) AS f4, round({_mle('1', '8')}, 5) AS f8, round({_mle('1', '14')}, 5) AS f14,
       round({_mle('4', '14')}, 5) AS b4, round({_mle('8', '14')}, 5) AS b8, round({_mle('1', '3')}, 5) AS b14 FROM g""")
def dimension_curves(spark, sf):
    c = D.dimension_curves(vectors.knn(T.points(spark, sf), 14, ["layer"]), [4, 8, 14], ["layer"])
    return c.select("layer", "id", *[F.round(F.col(col)[i], 5).alias(f"{col[0]}{k}") for col in ("forward", "backward") for i, k in enumerate((4, 8, 14))])


_Z = "CASE WHEN stddev_pop({c}) OVER w < 1e-8 THEN 0.0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END"


@query(f"""WITH {KNN14}, e8 AS (SELECT layer, least(id, neighbour) AS u, greatest(id, neighbour) AS v, min(distance) AS distance FROM knn WHERE rank <= 8 GROUP BY ALL),
b AS (SELECT layer, u AS a, v AS b, distance FROM e8 UNION ALL SELECT layer, v, u, distance FROM e8),
deg AS (SELECT layer, a, count(*) AS d, avg(distance) AS far FROM b GROUP BY ALL),
tri AS (SELECT x.layer, x.a, count(*) / 2 AS t FROM b x JOIN b y ON x.layer = y.layer AND x.a = y.a AND x.b <> y.b JOIN b z ON z.layer = x.layer AND z.a = x.b AND z.b = y.b GROUP BY ALL),
two AS (SELECT layer, a, count(*) AS r FROM (SELECT DISTINCT x.layer, x.a, y.b FROM b x JOIN b y ON x.layer = y.layer AND x.b = y.a WHERE x.a <> y.b) GROUP BY ALL),
dim AS (SELECT layer, id AS a, max(CASE WHEN rank = 1 THEN greatest(distance, 1e-12) END) AS r1, max(CASE WHEN rank = 2 THEN greatest(distance, 1e-12) END) AS r2, max(distance) AS rk, count(*) AS k, sum(ln(greatest(distance, 1e-12))) AS s FROM knn GROUP BY ALL),
own AS (SELECT layer, a, CASE WHEN r2 > r1 THEN greatest(0.1, least(200.0, 1 / ln(r2 / r1))) ELSE 0.0 END AS two_nn, CASE WHEN k * ln(rk) - s > 1e-12 THEN greatest(0.1, least(200.0, (k - 1) / (k * ln(rk) - s))) ELSE 0.0 END AS mle FROM dim),
n AS (SELECT layer, count(*) AS n FROM points GROUP BY layer),
g AS (SELECT layer, a AS node, d / (n.n - 1) AS degree, -far AS near, CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END AS clustering, coalesce(r, 0) / (n.n - 1) AS reach, own.two_nn AS t2, own.mle AS ml
  FROM deg JOIN n USING (layer) LEFT JOIN tri USING (layer, a) LEFT JOIN two USING (layer, a) JOIN own USING (layer, a))
SELECT layer, node, round(degree, 5) AS degree, round({_Z.format(c='near')}, 5) AS nearness, round(clustering, 5) AS clustering, round(reach, 5) AS reach, round({_Z.format(c='t2')}, 5) AS two_nn, round({_Z.format(c='ml')}, 5) AS mle
FROM g WINDOW w AS (PARTITION BY layer)""")
def geometric_signatures(spark, sf):
    s = D.geometric_signatures(T.points(spark, sf), 8, ["layer"])
    return s.select("layer", "node", *[F.round(c, 5).alias(c) for c in D.GEOMETRIC])


@query(f"""WITH {TRADE}, e AS (SELECT DISTINCT source, target FROM top), n AS (SELECT n_nationkey AS node, count(*) OVER () - 1 AS others FROM nation),
o AS (SELECT source AS node, count(*) AS k FROM e GROUP BY 1), i AS (SELECT target AS node, count(*) AS k FROM e GROUP BY 1),
m AS (SELECT a.source AS node, count(*) AS k FROM e a JOIN e b ON a.source = b.target AND a.target = b.source GROUP BY 1),
h AS (SELECT node, count(*) AS k FROM (SELECT DISTINCT a.source AS node, b.target AS z FROM e a JOIN e b ON a.target = b.source WHERE a.source <> b.target) GROUP BY 1),
t AS (SELECT x.a AS node, count(*) / 2 AS k FROM both_ways x JOIN both_ways y ON x.a = y.a AND x.b <> y.b JOIN both_ways z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT n.node, round(coalesce(o.k, 0) / others, 6) AS out_degree, round(coalesce(i.k, 0) / others, 6) AS in_degree, round(coalesce(degree, 0) / others, 6) AS degree,
       round(CASE WHEN degree > 0 THEN coalesce(m.k, 0) / degree ELSE 0.0 END, 6) AS reciprocity, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t.k, 0) / (degree * (degree - 1)) ELSE 0.0 END, 6) AS clustering,
       round(coalesce(h.k, 0) / others, 6) AS reach
FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node) LEFT JOIN m USING (node) LEFT JOIN h USING (node) LEFT JOIN t USING (node) LEFT JOIN deg USING (node)""")
def relational_signatures(spark, sf):
    nodes = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return D.relational_signatures(T.trade_top(spark, sf), nodes).select("node", *r6(*D.RELATIONAL))


@query(f"""WITH {TRADE}, l AS (SELECT source, target, CAST(w > (SELECT quantile_cont(w, 0.5) FROM top) AS INTEGER) AS label FROM top), p AS (SELECT * FROM l WHERE label > 0)
SELECT i, j, CAST(count(*) AS DOUBLE) AS w FROM (SELECT source AS i, target AS j FROM p UNION ALL SELECT target, source FROM p) GROUP BY ALL""")
def positive_adjacency(spark, sf):
    top = T.trade_top(spark, sf)
    cut = top.agg(F.percentile("w", F.lit(0.5)).alias("m"))
    edges = top.crossJoin(F.broadcast(cut)).select("source", "target", (F.col("w") > F.col("m")).cast("int").alias("label"))  # one row
    return D.positive_adjacency(edges, T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node")))


@query(f"WITH {TRADE} SELECT n_nationkey AS node, CAST(count(DISTINCT target) AS DOUBLE) AS activity FROM nation LEFT JOIN top ON n_nationkey = source GROUP BY 1")
def source_activity(spark, sf):
    nodes = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return D.source_activity(nodes, T.trade_top(spark, sf).select("source", "target"))


def _modules(spark, sf):
    return T.whole_points(spark, sf).select(F.col("label").alias("module"), F.col("vec_id").alias("node"))


@query(f"""WITH {POINTS}, l AS (SELECT label AS module, layer, unnest(vec) AS x, unnest(range(16)) AS d FROM points), m AS (SELECT module, layer, d, avg(x) AS x, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 3),
z AS (SELECT *, CASE WHEN stddev_pop(x) OVER w < 1e-8 THEN 0.0 ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM m WINDOW w AS (PARTITION BY layer, d)),
r AS (SELECT *, CASE WHEN layer = 0 THEN z / greatest(sqrt(sum(z * z) OVER (PARTITION BY layer, module)), 1e-12) ELSE z END AS v FROM z)
SELECT module, layer, CAST(d AS INTEGER) AS d, round(v, 6) AS v FROM r""")
def module_vectors(spark, sf):
    """Mean vectors of the labels in each layer, normalised over labels; in the first layer of length 1."""
    roles = T.points(spark, sf).select("layer", F.col("vec_id").alias("node"), "vec")
    v = D.module_vectors(_modules(spark, sf), roles, ["layer"])
    n = D.normalised_modules(v, ["layer"], F.col("layer") == 0)
    return n.select("module", "layer", F.posexplode("vec").alias("d", "v")).select("module", "layer", "d", *r6("v"))


@query(f"""WITH {POINTS}, c AS (SELECT label AS module, layer, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT module FROM c GROUP BY module HAVING count(*) = (SELECT count(DISTINCT layer) FROM c)), o AS (SELECT label AS module FROM embeddings GROUP BY label HAVING count(*) >= 3)
SELECT module FROM m JOIN o USING (module)""")
def common_modules(spark, sf):
    roles = T.points(spark, sf).select("layer", F.col("vec_id").alias("node"), "vec")
    other = T.whole_points(spark, sf).select(F.col("vec_id").alias("node"), "vec")
    m = _modules(spark, sf)
    return D.common_modules(D.module_vectors(m, roles, ["layer"]), D.module_vectors(m, other))


@query(f"""WITH {POINTS}, d AS (SELECT a.label AS module, a.layer, list_distance(a.vec, b.vec) AS d FROM points a JOIN points b ON a.label = b.label AND a.layer = b.layer AND a.vec_id < b.vec_id),
n AS (SELECT label AS module, layer, count(*) AS n FROM points GROUP BY ALL)
SELECT module, layer, any_value(n) AS n, {', '.join(f'round(quantile_cont(d, {int(q[1:]) / 100}), 5) AS {q}' for q in D.LANDSCAPE[:5])}, round(avg(d), 5) AS mean, round(stddev_pop(d), 5) AS sd
FROM d JOIN n USING (module, layer) GROUP BY ALL""")
def module_landscape(spark, sf):
    return D.module_landscape(T.points(spark, sf), _modules(spark, sf), ["layer"]).select("module", "layer", "n", *[F.round(c, 5).alias(c) for c in D.LANDSCAPE])


@query(f"""WITH {SCORED}, c AS (SELECT lang, count(*) AS n, quantile_cont(n_chars, [1 / 3, 2 / 3]) AS q FROM scored GROUP BY lang HAVING count(*) >= 10 AND min(quality) < max(quality)),
e AS (SELECT lang, n, 'high' AS part, quality AS y, n_chars AS a, toxic - n_chars / 1e6 AS b FROM scored JOIN c USING (lang) WHERE n_chars >= q[2]
  UNION ALL SELECT lang, n, 'low', quality, n_chars, toxic - n_chars / 1e6 FROM scored JOIN c USING (lang) WHERE n_chars <= q[1]),
a AS (SELECT * FROM ({auc_sql('e', 'lang, part', 'y', 'a')})), b AS (SELECT * FROM ({auc_sql('e', 'lang, part', 'y', 'b')})),
d AS (SELECT lang, part, b.auc - a.auc AS delta FROM a JOIN b USING (lang, part)),
g AS (SELECT lang, max(CASE WHEN part = 'high' THEN delta END) - max(CASE WHEN part = 'low' THEN delta END) AS gap FROM d GROUP BY lang)
SELECT round(sum(gap * n) / sum(n), 6) AS interaction FROM g JOIN c USING (lang) WHERE gap IS NOT NULL""")
def module_interaction(spark, sf):
    d = T.scored_documents(spark, sf).withColumn("other", F.col("toxic") - F.col("n_chars") / 1e6)
    return D.module_interaction(d, "lang", "n_chars", "quality", "n_chars", "other", 10).select(*r6("interaction"))


@query(f"""WITH {SCORED}, r AS (SELECT doc_id, lang, n_chars, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang, n_chars) AS t, count(*) OVER (PARTITION BY lang) AS n FROM scored),
b AS (SELECT *, CAST(least(floor((k + (t - 1) / 2.0) / n * 3), 2) AS INTEGER) AS bin, ln(1 + n_chars) AS base FROM r)
SELECT doc_id, round(base, 6) AS base, CAST(toxic AS DOUBLE) AS disagreement, CASE WHEN bin = 1 THEN 1.0 ELSE 0.0 END AS mid, CASE WHEN bin = 2 THEN 1.0 ELSE 0.0 END AS high,
       round(CASE WHEN bin = 1 THEN base ELSE 0.0 END, 6) AS base_mid, round(CASE WHEN bin = 2 THEN base ELSE 0.0 END, 6) AS base_high FROM b""")
def gated_features(spark, sf):
    d = T.scored_documents(spark, sf).withColumn("bin", S.rank_bins("n_chars", 3, ["lang"]))
    made = D.gated({"base": F.ln(1 + F.col("n_chars"))}, F.col("toxic").cast("double"), F.col("bin"))
    return d.select("doc_id", *[F.round(c, 6).alias(k) for k, c in made.items()])


_MASKED = [f"{c}_{k}" for k in range(3) for c in ("weighted", "gain", "margin", "confidence")]


@query(f"""WITH {SCORED}, b AS (SELECT doc_id, doc_id % 3 AS k, ln(1 + n_chars) AS base, sqrt(n_chars) AS weighted, CAST(quality - toxic AS DOUBLE) AS margin, CAST(quality AS DOUBLE) AS confidence FROM scored)
SELECT doc_id, round(base, 6) AS base, {', '.join(f"round(CASE WHEN k = {n.split('_')[1]} THEN {'weighted - base' if n.startswith('gain') else n.split('_')[0]} ELSE 0.0 END, 6) AS {n}" for n in _MASKED)} FROM b""")
def masked_by_stratum(spark, sf):
    d = T.scored_documents(spark, sf)
    made = D.masked_by_stratum(F.ln(1 + F.col("n_chars")), F.sqrt("n_chars"), (F.col("quality") - F.col("toxic")).cast("double"), F.col("quality").cast("double"), F.col("doc_id") % 3)
    return d.select("doc_id", *[F.round(c, 6).alias(k) for k, c in made.items()])


@query(f"""WITH {SCORED}, b AS (SELECT doc_id, ln(1 + n_chars) AS base, sqrt(n_chars) AS weighted, CAST(quality - toxic AS DOUBLE) AS margin, CAST(quality AS DOUBLE) AS confidence,
  CAST(doc_id % 5 AS DOUBLE) AS a1, CAST(doc_id % 7 AS DOUBLE) AS a2, CAST(doc_id % 3 AS DOUBLE) AS b1, CAST(doc_id % 4 AS DOUBLE) AS b2 FROM scored)
SELECT doc_id, round(base, 6) AS base, round(weighted, 6) AS weighted, round(weighted - base, 6) AS gain, margin, confidence, a1 AS anchor_one, a2 AS anchor_two, a2 - a1 AS anchor_gain,
       b1 AS background_one, b2 AS background_two, b2 - b1 AS background_gain, a1 - b1 AS relative_one, a2 - b2 AS relative_two, (a2 - a1) - (b2 - b1) AS relative_gain FROM b""")
def relative_connectivity(spark, sf):
    m = lambda k: (F.col("doc_id") % k).cast("double")
    made = D.relative_connectivity(
        F.ln(1 + F.col("n_chars")), F.sqrt("n_chars"), (F.col("quality") - F.col("toxic")).cast("double"), F.col("quality").cast("double"),
        {"one": m(5), "two": m(7), "gain": m(7) - m(5)}, {"one": m(3), "two": m(4), "gain": m(4) - m(3)},
    )
    return T.scored_documents(spark, sf).select("doc_id", *[F.round(c, 6).alias(k) for k, c in made.items()])


@query(f"""WITH {POINTS}, b AS (SELECT vec_id, layer, list_avg(vec) AS base, vec[1] AS gain FROM points),
r AS (SELECT *, rank() OVER (PARTITION BY layer ORDER BY base) AS k1, count(*) OVER (PARTITION BY layer, base) AS t1, rank() OVER (PARTITION BY layer ORDER BY gain) AS k2, count(*) OVER (PARTITION BY layer, gain) AS t2, count(*) OVER (PARTITION BY layer) AS n FROM b),
t AS (SELECT vec_id, layer, CAST(least(floor((k1 + (t1 - 1) / 2.0) / n * 4), 3) * 4 + least(floor((k2 + (t2 - 1) / 2.0) / n * 4), 3) AS INTEGER) AS t FROM r)
SELECT vec_id, string_agg(CAST(t AS VARCHAR), ' ' ORDER BY layer) AS tokens FROM t GROUP BY vec_id""")
def depth_tokens(spark, sf):
    p = T.points(spark, sf).select("vec_id", "layer", (X.total("vec") / F.size("vec")).alias("base"), F.col("vec")[0].alias("gain"))
    return D.depth_tokens(p, "base", "gain", 4, "vec_id").select("vec_id", F.array_join(F.transform("tokens", lambda t: t.cast("string")), " ").alias("tokens"))


@query("SELECT lang, source, CAST(doc_id % 4 AS INTEGER) AS layer, round(avg(CAST(n_chars AS DOUBLE)), 6) AS utility FROM documents GROUP BY ALL")
def mean_utility(spark, sf):
    d = T.table(spark, sf, "documents").select("lang", "source", (F.col("doc_id") % 4).cast("int").alias("layer"), F.col("n_chars").cast("double").alias("n_chars"))
    return d.groupBy("lang", "source", "layer").agg(F.avg("n_chars").alias("utility")).select("lang", "source", "layer", *r6("utility"))


@query("""WITH c AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(CAST(user_id AS VARCHAR) || '|cells'), user_id LIMIT 400),
v AS (SELECT user_id AS cell, event_type AS gene, sum(value) AS x FROM events WHERE user_id IN (SELECT user_id FROM c) GROUP BY ALL),
n AS (SELECT count(DISTINCT cell) AS n FROM v), g AS (SELECT DISTINCT gene FROM v), f AS (SELECT c.cell, g.gene, coalesce(v.x, 0) AS x FROM (SELECT DISTINCT cell FROM v) c CROSS JOIN g LEFT JOIN v ON v.cell = c.cell AND v.gene = g.gene)
SELECT p.gene AS a, q.gene AS b, round(abs(corr(p.x, q.x)), 6) AS r FROM f p JOIN f q ON p.cell = q.cell AND p.gene < q.gene GROUP BY ALL""")
def absolute_correlations(spark, sf):
    e = T.table(spark, sf, "events")
    cells = D.sampled(e, 400, "user_id").withColumnRenamed("user_id", "cell")
    v = e.groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).agg(F.sum("value").alias("value")).join(cells, "cell", "left_semi")
    return D.absolute_correlations(v).select("a", "b", *r6("r"))


@query("SELECT o_orderkey AS id, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS BIGINT) AS place FROM orders")
def ordered_categories(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), D.ordered(F.col("o_orderpriority"), ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]).alias("place"))


_SLOPE4 = "(-1.5 * {0} - 0.5 * {1} + 0.5 * {2} + 1.5 * {3})"


@query(f"""WITH {POINTS}, m AS (SELECT label, layer, avg(list_avg(vec)) AS x FROM points GROUP BY ALL),
o AS (SELECT a.label, {_SLOPE4.format('a.x', 'b.x', 'c.x', 'd.x')} AS s, a.layer = 0 AND b.layer = 1 AND c.layer = 2 AS own
  FROM m a JOIN m b ON a.label = b.label AND a.layer <> b.layer JOIN m c ON a.label = c.label AND c.layer NOT IN (a.layer, b.layer) JOIN m d ON a.label = d.label AND d.layer NOT IN (a.layer, b.layer, c.layer)),
w AS (SELECT label, max(CASE WHEN own THEN s END) AS seen FROM o GROUP BY label)
SELECT label, round(any_value(seen), 6) AS observed, CAST(count(*) AS INTEGER) AS n_orders, round(sum(CASE WHEN s >= seen - 1e-12 THEN 1 ELSE 0 END) / count(*), 6) AS p FROM o JOIN w USING (label) GROUP BY label""")
def exact_permutation_p(spark, sf):
    """Slope of a label's mean over the layers against that of all 24 orders of the layers."""
    m = T.points(spark, sf).groupBy("label", "layer").agg(F.avg(X.total("vec") / F.size("vec")).alias("x"))
    a = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "x"))), lambda e: e["x"]).alias("xs"))
    slope = lambda xs: -1.5 * xs[0] - 0.5 * xs[1] + 0.5 * xs[2] + 1.5 * xs[3]
    return D.exact_permutation_p(a, "xs", 4, slope, ["label"]).select("label", *r6("observed"), "n_orders", *r6("p"))


@query("""WITH s AS (SELECT CASE r_name WHEN 'EUROPE' THEN 'external_lung' WHEN 'ASIA' THEN 'immune' ELSE 'lung' END AS domain, n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'source_disjoint' WHEN 1 THEN 'target_disjoint' ELSE 'dual_axis_disjoint' END AS split
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, domain, split, CASE WHEN domain = 'external_lung' AND split = 'dual_axis_disjoint' THEN 280 WHEN domain = 'external_lung' THEN 220 WHEN domain = 'immune' AND split = 'dual_axis_disjoint' THEN 210 ELSE 170 END AS node_cap,
       CASE WHEN domain = 'external_lung' AND split = 'dual_axis_disjoint' THEN 75 WHEN domain = 'external_lung' THEN 95 WHEN domain = 'immune' AND split = 'dual_axis_disjoint' THEN 90 ELSE 120 END AS least_nodes,
       CASE WHEN domain = 'external_lung' AND split = 'dual_axis_disjoint' THEN 170 WHEN domain = 'external_lung' THEN 200 WHEN domain = 'immune' AND split = 'dual_axis_disjoint' THEN 195 ELSE 220 END AS edge_sample FROM s""")
def slice_budgets(spark, sf):
    n = T.table(spark, sf, "nation").join(T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    domain = F.when(F.col("r_name") == "EUROPE", "external_lung").when(F.col("r_name") == "ASIA", "immune").otherwise("lung")
    r = F.col("n_nationkey") % 3
    split = F.when(r == 0, "source_disjoint").when(r == 1, "target_disjoint").otherwise("dual_axis_disjoint")
    return D.with_budget(n.select("n_nationkey", domain.alias("domain"), split.alias("split")))


@query(f"""WITH {SCORED}, l AS (SELECT source, lang, quality - 0.5 AS delta, toxic - 0.5 AS gap, n_chars FROM scored)
SELECT lang, CASE k WHEN 0 THEN 'delta' ELSE 'gap' END AS measure, round(avg(CASE k WHEN 0 THEN delta ELSE gap END), 6) AS observed, round(avg(CASE k WHEN 0 THEN n_chars / 1e5 ELSE -n_chars / 1e5 END), 6) AS null_mean FROM l, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def observed_and_null_bars(spark, sf):
    d = T.scored_documents(spark, sf).select("lang", (F.col("quality") - 0.5).alias("delta"), (F.col("toxic") - 0.5).alias("gap"), (F.col("n_chars") / 1e5).alias("null_delta"), (-F.col("n_chars") / 1e5).alias("null_gap"))
    return audit.observed_and_null(d, {"delta": "null_delta", "gap": "null_gap"}, ["lang"]).select("lang", "measure", *r6("observed", "null_mean"))


_BOX = ", ".join(f"round(quantile_cont({{c}}, {q}), 6) AS {n}" for n, q in (("least", 0.0), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("most", 1.0)))


@query(f"""WITH {SCORED}, l AS (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'source_disjoint' ELSE 'target_disjoint' END AS split, n_chars / 1e3 AS delta, n_chars / 1e3 - 2 AS gap FROM scored)
SELECT lang, split, 'delta' AS panel, {_BOX.format(c='delta')} FROM l GROUP BY lang, split UNION ALL SELECT lang, split, 'gap', {_BOX.format(c='gap')} FROM l GROUP BY lang, split""")
def two_panel_boxes(spark, sf):
    split = F.when(F.col("doc_id") % 2 == 0, "source_disjoint").otherwise("target_disjoint")
    d = T.scored_documents(spark, sf).select("lang", split.alias("split"), (F.col("n_chars") / 1e3).alias("delta"), (F.col("n_chars") / 1e3 - 2).alias("gap"))
    return audit.box_panels(d, ["delta", "gap"], ["lang", "split"]).select("lang", "split", "panel", *r6("least", "q25", "median", "q75", "most"))


@query(f"""WITH {SCORED}, t AS (SELECT regr_slope(quality, n_chars) AS b, regr_intercept(quality, n_chars) AS a FROM scored WHERE doc_id % 2 = 0)
SELECT doc_id, round(a + b * n_chars, 6) AS predicted FROM scored, t WHERE doc_id % 2 = 1""")
def linear_predict(spark, sf):
    d = T.scored_documents(spark, sf)
    return models.linear_predict(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["n_chars"], "quality").select("doc_id", *r6("predicted"))


@query(f"""WITH RECURSIVE {TRADE}, n AS (SELECT n_nationkey AS node FROM nation), b AS (SELECT a, b FROM both_ways),
h AS (SELECT a, b, 1 AS k FROM b UNION SELECT h.a, b.b, k + 1 FROM h JOIN b ON h.b = b.a WHERE k < 24 AND h.a <> b.b),
d AS (SELECT a, b, min(k) AS k FROM h GROUP BY ALL)
SELECT p.node AS source, q.node AS target, CAST(CASE WHEN p.node = q.node THEN 0 ELSE coalesce(d.k, (SELECT max(k) + 1 FROM d)) END AS DOUBLE) AS hops FROM n p CROSS JOIN n q LEFT JOIN d ON d.a = p.node AND d.b = q.node""")
def hop_matrix(spark, sf):
    nodes = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.hop_matrix(T.trade_top(spark, sf), nodes)
