"""Queries over the driver tables, each an operator of the library on a whole table, and their
equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import expressions as X
from .functions import random as R
from .functions import stats as S
from .operators import alignment, geometry, graph, models, paths, rewire, sequences, support, topology, vectors
from .plans import audit, screen, screens
from .registry import KNN, POINTS, SCORED, TERMS, TOKENS, TRADE, auc_sql, query, r6
from .sources import tables as T

# metrics


@query(f"WITH {SCORED} SELECT lang, round(auc, 6) AS auc FROM ({auc_sql('scored', 'lang', 'quality', 'n_chars')})")
def auc_by_lang(spark, sf):
    return S.auc(T.scored_documents(spark, sf), "quality", "n_chars", ["lang"]).select("lang", *r6("auc"))


@query(f"""WITH {SCORED}, r AS (
  SELECT source, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0 AS x,
         rank() OVER (PARTITION BY source ORDER BY toxic) + (count(*) OVER (PARTITION BY source, toxic) - 1) / 2.0 AS y FROM scored)
SELECT source, count(*) AS n, round(CASE WHEN count(*) < 3 THEN NULL WHEN var_pop(x) = 0 OR var_pop(y) = 0 THEN 0.0 ELSE corr(x, y) END, 6) AS rho FROM r GROUP BY source""")
def spearman_by_source(spark, sf):
    return S.spearman(T.scored_documents(spark, sf), "n_chars", "toxic", ["source"]).select("source", "n", *r6("rho"))


@query(f"""WITH {SCORED}, s AS (SELECT *, n_chars / (SELECT max(n_chars) FROM scored) AS score FROM scored),
c AS (SELECT unnest(q) AS threshold, generate_subscripts(q, 1) AS k FROM (SELECT quantile_cont(score, [{', '.join(repr(0.05 + 0.9 * k / 36) for k in range(37))}]) AS q FROM s)),
f AS (SELECT k, threshold, sum(CASE WHEN score >= threshold AND quality = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold AND quality = 0 THEN 1 ELSE 0 END) AS fp,
             sum(CASE WHEN score < threshold AND quality = 1 THEN 1 ELSE 0 END) AS fn FROM s, c GROUP BY k, threshold),
g AS (SELECT *, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM f)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM g ORDER BY g.f1 DESC, k LIMIT 1""")
def f1_threshold(spark, sf):
    d = T.scored_documents(spark, sf)
    top = d.agg(F.max("n_chars").alias("top"))
    return S.best_f1_threshold(d.crossJoin(F.broadcast(top)).withColumn("score", F.col("n_chars") / F.col("top")), "quality", "score").select(*r6("threshold", "f1"))


@query(f"""WITH {SCORED}, s AS (SELECT *, 1 / (1 + exp(-(n_chars - 3000.0) / 3000.0)) AS a, 0.5 AS b FROM scored)
SELECT lang, round(avg((b - quality) * (b - quality)) - avg((a - quality) * (a - quality)), 6) AS brier_gain,
       round(avg(-CASE WHEN quality > 0 THEN ln(greatest(1e-6, least(1 - 1e-6, a))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, a))) END), 6) AS log_loss FROM s GROUP BY lang""")
def brier_and_log_loss(spark, sf):
    a = 1 / (1 + F.exp(-(F.col("n_chars") - 3000.0) / 3000.0))
    d = T.scored_documents(spark, sf).withColumn("a", a).withColumn("b", F.lit(0.5))
    y = F.col("quality")
    return d.groupBy("lang").agg((S.brier(y, F.col("b")) - S.brier(y, F.col("a"))).alias("brier_gain"), S.log_loss(y, F.col("a")).alias("log_loss")).select("lang", *r6("brier_gain", "log_loss"))


@query(f"""WITH {SCORED}, q AS (SELECT quantile_cont(n_chars, 0.5) AS m FROM scored), s AS (SELECT *, CASE WHEN n_chars >= m THEN 1 ELSE 0 END AS hit FROM scored, q)
SELECT lang, round(CASE WHEN sum(hit) > 0 THEN sum(hit * quality) / sum(hit) ELSE 0 END, 6) AS precision,
       round(CASE WHEN sum(quality) > 0 THEN sum(hit * quality) / sum(quality) ELSE 0 END, 6) AS recall,
       round(CASE WHEN sum(hit * quality) > 0 THEN 2 * sum(hit * quality) / (sum(hit) + sum(quality)) ELSE 0 END, 6) AS f1 FROM s GROUP BY lang""")
def precision_recall(spark, sf):
    d = T.scored_documents(spark, sf)
    m = d.agg(F.percentile("n_chars", F.lit(0.5)).alias("m"))
    d = d.crossJoin(F.broadcast(m)).withColumn("hit", (F.col("n_chars") >= F.col("m")).cast("int"))
    return d.groupBy("lang").agg(*[c.alias(k) for k, c in S.confusion(F.col("quality"), F.col("hit")).items()]).select("lang", *r6("precision", "recall", "f1"))


# bins, strata and splits


@query(f"""WITH {SCORED}, r AS (SELECT doc_id, lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang, n_chars) AS t, count(*) OVER (PARTITION BY lang) AS n FROM scored),
q AS (SELECT *, greatest(1, least(5, CAST(floor(sqrt(n)) AS BIGINT))) AS b FROM r)
SELECT doc_id, CAST(least(floor((k + (t - 1) / 2.0) / n * b), b - 1) AS INTEGER) AS bin FROM q""")
def degree_bins(spark, sf):
    return T.scored_documents(spark, sf).select("doc_id", S.degree_bins("n_chars", 5, ["lang"]).alias("bin"))


@query(f"""WITH {SCORED}, e AS (SELECT list_sort(list_distinct(quantile_cont(n_chars, [0.2, 0.4, 0.6, 0.8]))) AS edges FROM scored)
SELECT doc_id, CAST(len(list_filter(edges, lambda x: n_chars > x)) AS INTEGER) AS bin FROM scored, e""")
def qcut_bins(spark, sf):
    d = T.scored_documents(spark, sf)
    e = d.agg(F.array_sort(F.array_distinct(S.quantile("n_chars", [0.2, 0.4, 0.6, 0.8]))).alias("edges"))
    return d.crossJoin(F.broadcast(e)).select("doc_id", F.size(F.filter("edges", lambda x: F.col("n_chars") > x)).alias("bin"))


@query(f"""WITH {SCORED}, c AS (SELECT lang, count(*) AS n, quantile_cont(n_chars, 1 / 3.0) AS a, quantile_cont(n_chars, 2 / 3.0) AS b FROM scored GROUP BY lang),
o AS (SELECT lang, n, avg(CASE WHEN n_chars >= b THEN quality END) - avg(CASE WHEN n_chars <= a THEN quality END) AS own FROM scored JOIN c USING (lang) GROUP BY lang, n),
g AS (SELECT avg(CASE WHEN n_chars >= b THEN quality END) - avg(CASE WHEN n_chars <= a THEN quality END) AS al FROM scored, (SELECT quantile_cont(n_chars, 1 / 3.0) AS a, quantile_cont(n_chars, 2 / 3.0) AS b FROM scored))
SELECT lang, n, round(CASE WHEN n >= 8 THEN coalesce(own, al) ELSE al END, 6) AS delta FROM o, g""")
def tercile_interaction(spark, sf):
    return support.tercile_delta(T.scored_documents(spark, sf), "n_chars", "quality", "lang").select("lang", "n", *r6("delta"))


@query("""WITH d AS (SELECT l_suppkey AS u, l_partkey AS v, count(*) AS w FROM lineitem GROUP BY ALL), m AS (SELECT quantile_cont(u, 0.5) AS mu, quantile_cont(v, 0.5) AS mv FROM d),
s AS (SELECT 'source_disjoint' AS split, w FROM d, m WHERE u <= mu UNION ALL SELECT 'target_disjoint', w FROM d, m WHERE v > mv UNION ALL SELECT 'dual_axis', w FROM d, m WHERE u <= mu AND v > mv)
SELECT split, count(*) AS n_edges, CAST(sum(w) AS BIGINT) AS w FROM s GROUP BY split""")
def median_split_masks(spark, sf):
    e = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    return screen.split_masks(e).groupBy("split").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("w"))


@query("""SELECT node, count(*) AS degree FROM (SELECT l_suppkey AS node FROM lineitem UNION ALL SELECT l_partkey FROM lineitem) GROUP BY node ORDER BY count(*) DESC, node LIMIT 50""")
def top_nodes_by_degree(spark, sf):
    return graph.top_nodes(T.table(spark, sf, "lineitem"), 50, "l_suppkey", "l_partkey")


@query(f"""WITH {SCORED}, t AS (SELECT count(*) AS n FROM scored), r AS (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|sample'), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS k FROM scored)
SELECT doc_id, quality FROM r, t WHERE r.r <= CASE WHEN n <= 100 THEN k ELSE greatest(1, round(100.0 * k / n)) END""")
def stratified_sample(spark, sf):
    return R.stratified_sample(T.scored_documents(spark, sf), 100, "doc_id", "sample", "quality").select("doc_id", "quality")


# vectors and neighbours


@query(f"""WITH {KNN} SELECT layer, id, neighbour, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM knn""")
def knn_neighbours(spark, sf):
    return vectors.knn(T.points(spark, sf), 8, ["layer"]).select("layer", "id", "neighbour", *r6("distance"), F.col("rank").cast("int").alias("rank"))


@query(f"""WITH {KNN} SELECT layer, u, v, round(distance, 6) AS distance FROM knn_edges""")
def knn_edges(spark, sf):
    return _edges(spark, sf).select("layer", "u", "v", *r6("distance"))


def _edges(spark, sf):
    return vectors.knn_edges(vectors.knn(T.points(spark, sf), 8, ["layer"]), ["layer"])


@query(f"""WITH {KNN}, b AS (SELECT layer, u AS node FROM knn_edges UNION ALL SELECT layer, v FROM knn_edges) SELECT layer, node, count(*) AS degree FROM b GROUP BY ALL""")
def knn_degree(spark, sf):
    return graph.degrees(_edges(spark, sf), ["layer"])


@query(f"""WITH {KNN}, s AS (SELECT layer, id, list(neighbour) AS n FROM knn GROUP BY ALL)
SELECT a.layer, round(avg(len(list_intersect(a.n, b.n)) / len(list_distinct(list_concat(a.n, b.n)))), 6) AS mean_jaccard, count(*) AS n FROM s a JOIN s b ON a.id = b.id AND a.layer + 1 = b.layer GROUP BY a.layer""")
def knn_jaccard_blocks(spark, sf):
    n = vectors.knn(T.points(spark, sf), 8, ["layer"])
    ahead = n.select((F.col("layer") - 1).alias("layer"), "id", "neighbour")
    return vectors.mean_jaccard(n, ahead, ["layer"]).select("layer", *r6("mean_jaccard"), "n")


@query(f"""WITH {KNN}, m AS (SELECT layer, quantile_cont(distance, 0.5) AS m FROM knn_edges GROUP BY layer) SELECT layer, u, v, round(exp(-distance / greatest(m, 1e-12)), 6) AS w FROM knn_edges JOIN m USING (layer)""")
def knn_kernel_weights(spark, sf):
    return vectors.kernel_weights(_edges(spark, sf), ["layer"]).select("layer", "u", "v", *r6("w"))


@query(f"""WITH {KNN} SELECT layer, id, round(CASE WHEN max(CASE WHEN rank = 2 THEN d END) > max(CASE WHEN rank = 1 THEN d END) THEN greatest(0.1, least(200.0, 1 / ln(max(CASE WHEN rank = 2 THEN d END) / max(CASE WHEN rank = 1 THEN d END)))) END, 5) AS two_nn,
  round(greatest(0.1, least(200.0, (count(*) - 1) / (count(*) * ln(max(d)) - sum(ln(d))))), 5) AS mle FROM (SELECT *, greatest(distance, 1e-12) AS d FROM knn) GROUP BY layer, id""")
def local_dimension(spark, sf):
    n = vectors.knn(T.points(spark, sf), 8, ["layer"])
    return vectors.local_dimension(n, ["layer"]).select("layer", "id", F.round("two_nn", 5).alias("two_nn"), F.round("mle", 5).alias("mle"))


@query(f"""WITH {POINTS}, x AS (SELECT label, layer, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM points), v AS (SELECT label, layer, d, var_samp(x) AS v FROM x GROUP BY ALL)
SELECT label, layer, round(sum(v) * sum(v) / sum(v * v), 6) AS participation_ratio, round(sum(CASE WHEN d <= 5 THEN v END) / sum(v), 6) AS linearity FROM v GROUP BY ALL""")
def participation_ratio(spark, sf):
    return vectors.participation_ratio(T.points(spark, sf), ["label", "layer"]).select("label", "layer", *r6("participation_ratio", "linearity"))


@query(f"""WITH {POINTS}, x AS (SELECT label, layer, vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM points),
z AS (SELECT label, layer, vec_id, d, CASE WHEN stddev_pop(x) OVER w < 1e-8 THEN 0 ELSE (x - avg(x) OVER w) / stddev_pop(x) OVER w END AS z FROM x WINDOW w AS (PARTITION BY label, layer, d))
SELECT label, layer, vec_id, round(sqrt(sum(z * z)), 6) AS z_norm, round(sum(z * d), 5) AS z_moment FROM z GROUP BY ALL""")
def column_zscore(spark, sf):
    z = vectors.column_zscores(T.points(spark, sf), ["label", "layer"])
    return z.select("label", "layer", "vec_id", F.round(X.norm("vec"), 6).alias("z_norm"), F.round(X.total(F.transform("vec", lambda x, i: x * (i + 1))), 5).alias("z_moment"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT id, neighbour, round(1 - c, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(1 - c, 9), neighbour) AS r FROM c) WHERE r <= 5""")
def pair_cosine_topk(spark, sf):
    return vectors.knn(T.whole_points(spark, sf), 5, metric="cosine").select("id", "neighbour", *r6("distance"))


@query(f"""WITH {POINTS}, x AS (SELECT label, layer, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM points), m AS (SELECT label, layer, d, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL),
c AS (SELECT label, layer, max(n) AS n, list(m ORDER BY d) AS vec FROM m GROUP BY ALL)
SELECT a.layer, a.label AS u, b.label AS v, a.n AS n_u, round(list_distance(a.vec, b.vec), 6) AS distance FROM c a JOIN c b ON a.layer = b.layer AND a.label < b.label""")
def module_centroid_distances(spark, sf):
    c = vectors.centroids(T.points(spark, sf), "label", ["layer"])
    p = c.select("layer", F.col("label").alias("u"), F.col("n").alias("n_u"), F.col("vec").alias("x")).join(c.select("layer", F.col("label").alias("v"), F.col("vec").alias("y")), "layer").where("u < v")
    return p.select("layer", "u", "v", "n_u", F.round(X.distance("x", "y"), 6).alias("distance"))


@query(f"""WITH {POINTS}, p AS (SELECT a.vec_id, a.layer, a.vec AS x, b.vec AS y FROM points a JOIN points b ON a.vec_id = b.vec_id AND a.layer + 1 = b.layer),
e AS (SELECT vec_id, layer, i, j, x[i] AS p, y[j] AS q, x[j] AS px, y[i] AS qy FROM p, (SELECT unnest(range(1, 17)) AS i), (SELECT unnest(range(1, 17)) AS j)),
g AS (SELECT layer, i, j, sum(p * q) - sum(p) * sum(q) / count(*) AS xy, sum(p * px) - sum(p) * sum(px) / count(*) AS xx, sum(qy * q) - sum(qy) * sum(q) / count(*) AS yy FROM e GROUP BY layer, i, j)
SELECT layer, round(sum(xy * xy) / sqrt(sum(xx * xx) * sum(yy * yy)), 6) AS cka FROM g GROUP BY layer""")
def linear_cka(spark, sf):
    return alignment.linear_cka(_paired(spark, sf), ["layer"]).select("layer", *r6("cka"))


def _paired(spark, sf, keys=("layer",)):
    """Each layer's points beside those of the next."""
    p = T.points(spark, sf)
    return alignment.paired(p, p.withColumn("layer", F.col("layer") - 1), list(keys))


@query(f"""WITH {POINTS}, p AS (SELECT a.layer, a.vec AS x, b.vec AS y FROM points a JOIN points b ON a.vec_id = b.vec_id AND a.layer + 1 = b.layer),
e AS (SELECT layer, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, x[i] AS p, y[j] AS q FROM p, (SELECT unnest(range(1, 17)) AS i), (SELECT unnest(range(1, 17)) AS j))
SELECT layer, i, j, round(sum(p * q) - sum(p) * sum(q) / count(*), 5) AS g FROM e GROUP BY layer, i, j""")
def procrustes_gram(spark, sf):
    return alignment.gram(_paired(spark, sf), ["layer"]).select("layer", "i", "j", F.round("g", 5).alias("g"))


@query(f"""WITH {POINTS}, p AS (SELECT a.label, a.layer, a.vec AS x, b.vec AS y FROM points a JOIN points b ON a.vec_id = b.vec_id AND a.layer + 1 = b.layer)
SELECT label, layer, count(*) AS n, round(avg(list_cosine_similarity(x, y)), 6) AS mean_cosine FROM p GROUP BY label, layer""")
def row_cosine(spark, sf):
    keys = ["label", "layer"]
    return alignment.row_cosine(_paired(spark, sf, keys), keys).select(*keys, "n", *r6("mean_cosine"))


# graphs


def _und(spark, sf):
    return graph.undirected(T.trade_top(spark, sf))


@query(f"""WITH {TRADE}, t AS (SELECT x.a AS node, count(*) AS t FROM both_ways x JOIN both_ways y ON x.a = y.a AND x.b < y.b JOIN und ON u = x.b AND v = y.b GROUP BY x.a)
SELECT node, degree, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM deg LEFT JOIN t USING (node)""")
def local_clustering(spark, sf):
    return graph.local_clustering(_und(spark, sf)).select("node", "degree", *r6("clustering"))


@query(f"""WITH {KNN}, b AS (SELECT layer, u AS a, v AS b FROM knn_edges UNION ALL SELECT layer, v, u FROM knn_edges)
SELECT x.layer, count(*) AS n_triangles FROM b x JOIN b y ON x.layer = y.layer AND x.b = y.a JOIN b z ON y.layer = z.layer AND y.b = z.a AND z.b = x.a WHERE x.a < x.b AND x.b < y.b GROUP BY x.layer""")
def triangle_count(spark, sf):
    return graph.triangles(_edges(spark, sf), ["layer"]).groupBy("layer").agg(F.count(F.lit(1)).alias("n_triangles"))


@query(f"""WITH {TRADE}, h AS (SELECT DISTINCT x.a, y.b FROM both_ways x JOIN both_ways y ON x.b = y.a WHERE x.a <> y.b)
SELECT a AS node, round(count(*) / 24.0, 6) AS reach FROM h GROUP BY a""")
def two_hop_reach(spark, sf):
    return graph.two_hop_reach(_und(spark, sf), 25).select("node", *r6("reach"))


@query(f"""WITH {TRADE} SELECT a.source, count(*) AS out_degree, round(avg(CASE WHEN b.source IS NULL THEN 0.0 ELSE 1.0 END), 6) AS reciprocity FROM top a LEFT JOIN top b ON a.source = b.target AND a.target = b.source GROUP BY a.source""")
def reciprocity(spark, sf):
    return graph.reciprocity(T.trade_top(spark, sf)).select("source", "out_degree", *r6("reciprocity"))


@query(f"""WITH {TRADE} SELECT u, v, 4 - a.degree - b.degree AS curvature FROM und JOIN deg a ON u = a.node JOIN deg b ON v = b.node""")
def forman_curvature(spark, sf):
    return graph.forman_curvature(_und(spark, sf))


@query(f"""WITH {TRADE}, s AS (SELECT u, v, count(*) AS shared FROM und JOIN both_ways x ON x.a = u JOIN both_ways y ON y.a = v AND y.b = x.b GROUP BY u, v)
SELECT u, v, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / (a.degree + b.degree - coalesce(shared, 0)), 6) AS jaccard, round(1 - coalesce(shared, 0) / (a.degree + b.degree - coalesce(shared, 0)), 6) AS bridge
FROM und LEFT JOIN s USING (u, v) JOIN deg a ON u = a.node JOIN deg b ON v = b.node""")
def edge_bridge_jaccard(spark, sf):
    return graph.edge_overlap(_und(spark, sf)).select("u", "v", "shared", *r6("jaccard", "bridge"))


@query(f"""WITH {KNN}, b AS (SELECT layer, u AS a, v AS b FROM knn_edges UNION ALL SELECT layer, v, u FROM knn_edges), d AS (SELECT layer, a, count(*) AS k FROM b GROUP BY ALL)
SELECT b.layer, round(coalesce(corr(x.k, y.k), 0), 6) AS assortativity FROM b JOIN d x ON b.layer = x.layer AND b.a = x.a JOIN d y ON b.layer = y.layer AND b.b = y.a GROUP BY b.layer""")
def assortativity(spark, sf):
    return graph.assortativity(_edges(spark, sf), ["layer"]).select("layer", *r6("assortativity"))


MOTIFS = {
    "feed_forward": "SELECT DISTINCT x.source AS a, x.target AS b, y.target AS c FROM top x JOIN top y ON x.target = y.source JOIN top z ON z.source = x.source AND z.target = y.target",
    "feedback": "SELECT DISTINCT x.source AS a, x.target AS b, y.target AS c FROM top x JOIN top y ON x.target = y.source JOIN top z ON z.source = y.target AND z.target = x.source WHERE x.source < x.target AND x.source < y.target AND x.target <> y.target",
    "chain": "SELECT DISTINCT x.source AS a, x.target AS b, y.target AS c FROM top x JOIN top y ON x.target = y.source WHERE x.source <> y.target AND NOT EXISTS (SELECT 1 FROM top z WHERE z.source = x.source AND z.target = y.target)",
    "multi_input": "SELECT DISTINCT x.source AS a, y.source AS b, x.target AS c FROM top x JOIN top y ON x.target = y.target AND x.source < y.source WHERE NOT EXISTS (SELECT 1 FROM und WHERE u = x.source AND v = y.source)",
}


def _motif(name, f):
    sort = "list_sort([a, b, c])" if name == "feedback" else "[a, b, c]"
    sql = f"WITH {TRADE} SELECT DISTINCT '{name}' AS kind, array_to_string({sort}, ',') AS nodes FROM ({MOTIFS[name]})"

    def run(spark, sf):
        return f(T.trade_top(spark, sf)).select("kind", F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string"))).alias("nodes"))

    run.__name__ = f"motif_{name}"
    query(sql)(run)


_motif("feed_forward", graph.feed_forward_loops)
_motif("feedback", graph.feedback_triads)
_motif("chain", graph.chains)
_motif("multi_input", graph.multi_inputs)


@query(f"""WITH {TRADE}, c AS (SELECT x.source AS a, y.source AS b, x.target AS t FROM top x JOIN top y ON x.target = y.target AND x.source < y.source)
SELECT 'bifan' AS kind, x.a || ',' || x.b || ',' || x.t || ',' || y.t AS nodes FROM c x JOIN c y ON x.a = y.a AND x.b = y.b AND x.t < y.t WHERE x.b NOT IN (x.t, y.t) AND x.a NOT IN (x.t, y.t)""")
def motif_bifan(spark, sf):
    return graph.bifans(T.trade_top(spark, sf)).select("kind", F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string"))).alias("nodes"))


@query(f"""WITH {TRADE}, heavy AS (SELECT * FROM top WHERE w > (SELECT quantile_cont(w, 0.5) FROM top)),
a AS (SELECT DISTINCT x.source AS a, x.target AS b, y.target AS c FROM top x JOIN top y ON x.target = y.source JOIN top z ON z.source = x.source AND z.target = y.target),
b AS (SELECT DISTINCT x.source AS a, x.target AS b, y.target AS c FROM heavy x JOIN heavy y ON x.target = y.source JOIN heavy z ON z.source = x.source AND z.target = y.target)
SELECT 'feed_forward' AS kind, (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both WHERE (SELECT count(*) FROM a) > 0""")
def motif_overlap(spark, sf):
    e = T.trade_top(spark, sf)
    m = e.agg(F.percentile("w", F.lit(0.5)).alias("m"))
    heavy = e.crossJoin(F.broadcast(m)).where("w > m")
    return graph.motif_overlap(graph.feed_forward_loops(e), graph.feed_forward_loops(heavy))


@query(f"""WITH {TRADE}, n AS (SELECT n_regionkey AS module, count(*) AS n FROM nation GROUP BY ALL),
i AS (SELECT a.n_regionkey AS module, count(*) AS n_edges FROM top JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey GROUP BY ALL)
SELECT module, n, coalesce(n_edges, 0) AS n_edges, round(CASE WHEN n > 1 THEN coalesce(n_edges, 0) / (n * (n - 1)) ELSE 0 END, 6) AS density FROM n LEFT JOIN i USING (module)""")
def module_density(spark, sf):
    return graph.module_density(T.trade_top(spark, sf), _regions(spark, sf)).select("module", "n", "n_edges", *r6("density"))


def _regions(spark, sf):
    return T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("module"))


@query(f"""WITH {TRADE} SELECT DISTINCT a.n_regionkey AS source, b.n_regionkey AS target FROM top JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey""")
def collapsed_modules(spark, sf):
    return graph.collapse(T.trade_top(spark, sf), _regions(spark, sf))


@query(f"""WITH {TRADE}, m AS (SELECT count(*) AS m FROM und), d AS (SELECT n_regionkey AS r, sum(degree) AS d FROM deg JOIN nation ON node = n_nationkey GROUP BY ALL),
e AS (SELECT a.n_regionkey AS r, count(*) AS e FROM und JOIN nation a ON u = a.n_nationkey JOIN nation b ON v = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey GROUP BY ALL)
SELECT round(sum(coalesce(e, 0) / m - (d / (2.0 * m)) * (d / (2.0 * m))), 6) AS modularity FROM d LEFT JOIN e USING (r), m""")
def modularity(spark, sf):
    return graph.modularity(_und(spark, sf), _regions(spark, sf)).select(*r6("modularity"))


@query(f"""WITH {TRADE}, s AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(w) AS w FROM trade WHERE source <> target GROUP BY ALL),
t AS (SELECT a, b, w FROM s UNION ALL SELECT b, a, w FROM s), p AS (SELECT x.a AS i, y.b AS j, sum(x.w * y.w) AS p FROM t x JOIN t y ON x.b = y.a WHERE x.a <> y.b GROUP BY ALL)
SELECT i, j, round(p / (SELECT max(p) FROM p), 6) AS closure FROM p""")
def triad_closure(spark, sf):
    e = T.trade(spark, sf).where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("w").alias("w"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return graph.triad_closure(both).select("i", "j", *r6("closure"))


@query(f"""WITH {TRADE}, p AS (SELECT source AS i, target AS j, w / sum(w) OVER (PARTITION BY source) AS p FROM trade), q AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM p a JOIN p b ON a.j = b.i GROUP BY ALL),
n AS (SELECT DISTINCT i FROM q), k AS (SELECT DISTINCT j FROM q), f AS (SELECT n.i, k.j, coalesce(p, 0) AS p FROM n CROSS JOIN k LEFT JOIN q ON q.i = n.i AND q.j = k.j)
SELECT a.i AS u, b.i AS v, round(sqrt(sum((a.p - b.p) * (a.p - b.p))), 5) AS distance FROM f a JOIN f b ON a.j = b.j AND a.i < b.i GROUP BY ALL""")
def diffusion_distance(spark, sf):
    t = graph.row_stochastic(T.trade(spark, sf).select(F.col("source").alias("i"), F.col("target").alias("j"), "w"))
    return graph.diffusion_distance(t, 2).select("u", "v", F.round("distance", 5).alias("distance"))


@query(f"""WITH {TRADE}, two AS (SELECT x.source AS i, y.target AS j, count(*) AS n FROM top x JOIN top y ON x.target = y.source GROUP BY ALL)
SELECT t.source, t.target, round(coalesce(a.n, 0) - coalesce(b.n, 0) + tanh(3.5 * (t.w - coalesce(o.w, 0)) / 1000.0), 6) AS score
FROM top t LEFT JOIN top o ON o.source = t.target AND o.target = t.source LEFT JOIN two a ON a.i = t.source AND a.j = t.target LEFT JOIN two b ON b.i = t.target AND b.j = t.source""")
def signed_path_scores(spark, sf):
    m = graph.margin(T.trade_top(spark, sf)).withColumn("margin", F.col("margin") / 1000.0)
    return topology.signed_path_scores(m).select("source", "target", *r6("score"))


@query(f"""WITH RECURSIVE {TRADE}, h AS (SELECT a AS u, b AS v, 1 AS hops FROM both_ways UNION SELECT h.u, b, hops + 1 FROM h JOIN both_ways ON v = a WHERE hops < 4 AND h.u <> b)
SELECT u, v, CAST(min(hops) AS INTEGER) AS hops FROM h GROUP BY u, v""")
def hop_distances(spark, sf):
    return graph.hop_distances(_und(spark, sf), 4)


# annotation support


@query(f"WITH {TERMS}, n AS (SELECT term, count(*) AS n FROM terms GROUP BY term) SELECT term, n, round(ln(((SELECT count(DISTINCT symbol) FROM terms) + 1) / (n + 1)), 6) AS ic FROM n")
def term_ic(spark, sf):
    return support.information_content(T.customer_brands(spark, sf)).select("term", "n", *r6("ic"))


@query(f"""WITH {TERMS}, s AS (SELECT symbol, list(term) AS t FROM terms GROUP BY symbol)
SELECT a.symbol AS u, b.symbol AS v, len(list_intersect(a.t, b.t)) AS shared, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
FROM s a JOIN s b ON a.symbol < b.symbol WHERE len(list_intersect(a.t, b.t)) > 0""")
def term_jaccard(spark, sf):
    return support.shared_terms(T.customer_brands(spark, sf), 6).select("u", "v", "shared", "jaccard")


@query(f"""WITH {TERMS}, s AS (SELECT symbol, list(DISTINCT term) AS t FROM terms GROUP BY symbol)
SELECT a.symbol AS u, b.symbol AS v, len(list_intersect(a.t, b.t)) AS shared, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
FROM s a JOIN s b ON a.symbol < b.symbol WHERE len(list_intersect(a.t, b.t)) >= 0.3 * len(list_distinct(list_concat(a.t, b.t)))""")
def similar_terms(spark, sf):
    """Pairs of term sets with a Jaccard similarity of 0.3 or more, through the rarest terms."""
    return support.similar_terms(T.customer_brands(spark, sf), 0.3, digits=6).select("u", "v", "shared", "jaccard")


@query(f"""WITH {TERMS}, n AS (SELECT term, ln(((SELECT count(DISTINCT symbol) FROM terms) + 1) / (count(*) + 1)) AS ic FROM terms GROUP BY term),
t AS (SELECT symbol, term, ic FROM terms JOIN n USING (term)), o AS (SELECT symbol, sum(ic) AS s, count(*) AS k FROM t GROUP BY symbol),
g AS (SELECT a.symbol AS u, b.symbol AS v, sum(a.ic) AS c, max(a.ic) AS r, count(*) AS k FROM t a JOIN t b ON a.term = b.term AND a.symbol < b.symbol GROUP BY ALL)
SELECT u, v, round(CASE WHEN x.s + y.s > 0 THEN 2 * c / (x.s + y.s) ELSE 0 END, 6) AS lin, round(r, 6) AS resnik, round(g.k / least(x.k, y.k), 6) AS overlap
FROM g JOIN o x ON u = x.symbol JOIN o y ON v = y.symbol""")
def lin_resnik(spark, sf):
    return support.semantic_similarity(T.customer_brands(spark, sf), 6, ("lin", "resnik", "overlap"))


def _evidence(spark, sf):
    w = T.trade(spark, sf).where("source <> target")
    top = w.agg(F.max("w").alias("top"))
    grade = w.crossJoin(F.broadcast(top)).select("source", "target", (F.col("w") / F.col("top")).alias("value"))
    near = T.trade_top(spark, sf).select("source", "target", F.lit(1.0).alias("value"))
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    same = n.select(F.col("n_nationkey").alias("source"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("target"), "n_regionkey"), "n_regionkey").where("source <> target").select("source", "target", F.lit(1.0).alias("value"))
    return w.select("source", "target"), {"grade": grade, "association": near, "terms": same}


@query(f"""WITH {TRADE} SELECT t.source, t.target, round(0.35 * t.w / (SELECT max(w) FROM trade WHERE source <> target) + CASE WHEN p.source IS NULL THEN 0 ELSE 0.35 END + CASE WHEN a.n_regionkey = b.n_regionkey THEN 0.2 ELSE 0 END, 6) AS support
FROM trade t LEFT JOIN top p ON t.source = p.source AND t.target = p.target JOIN nation a ON t.source = a.n_nationkey JOIN nation b ON t.target = b.n_nationkey WHERE t.source <> t.target""")
def support_score(spark, sf):
    pairs, evidence = _evidence(spark, sf)
    return support.support_score(pairs, evidence).select("source", "target", *r6("support"))


@query(f"""WITH {TRADE} SELECT t.source, t.target, CASE WHEN p.source IS NULL THEN 0 ELSE 1 END + CASE WHEN a.n_regionkey = b.n_regionkey THEN 1 ELSE 0 END AS tier
FROM trade t LEFT JOIN top p ON t.source = p.source AND t.target = p.target JOIN nation a ON t.source = a.n_nationkey JOIN nation b ON t.target = b.n_nationkey WHERE t.source <> t.target""")
def consensus_tier(spark, sf):
    pairs, evidence = _evidence(spark, sf)
    return support.consensus_tier(pairs, evidence["association"], evidence["terms"])


@query("""SELECT upper(c_mktsegment) AS source, upper(n_name) AS target, max(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 1 WHEN '5' THEN 0 ELSE 0 END) AS score
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def conf_max_dedupe(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    grade = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE")
    return T.confidence_scores(rows.select(F.col("c_mktsegment").alias("source"), F.col("n_name").alias("target"), grade.alias("confidence")))


@query(f"""WITH {TERMS}, s AS (SELECT term AS module, list_sort(list(symbol)) AS symbols, count(*) AS n FROM terms GROUP BY term),
f AS (SELECT *, row_number() OVER (PARTITION BY symbols ORDER BY module) AS r FROM s WHERE n BETWEEN 3 AND 100000)
SELECT module, CAST(n AS INTEGER) AS n, symbols[1] AS first_symbol FROM f WHERE r = 1 ORDER BY n DESC, module LIMIT 12""")
def select_modules(spark, sf):
    return support.select_modules(T.customer_brands(spark, sf), 3, 100_000, 12).select("module", "n", F.col("symbols")[0].alias("first_symbol"))


@query(f"""WITH {TERMS}, c AS (SELECT term FROM terms GROUP BY term ORDER BY count(*) DESC, term LIMIT 8)
SELECT s.symbol, coalesce(min(c.term), 'OTHER') AS module FROM terms s LEFT JOIN c USING (term) GROUP BY s.symbol""")
def assign_modules(spark, sf):
    t = T.customer_brands(spark, sf)
    return support.assign_module(t, support.top_terms(t, 8))


@query(f"""WITH {TRADE}, m AS (SELECT t.source, t.target, (t.w - coalesce(o.w, 0)) / 1000.0 AS margin, a.n_regionkey AS cs, b.n_regionkey AS ct FROM top t LEFT JOIN top o ON o.source = t.target AND o.target = t.source
  JOIN nation a ON t.source = a.n_nationkey JOIN nation b ON t.target = b.n_nationkey), g AS (SELECT *, abs(margin - avg(margin) OVER (PARTITION BY cs, ct)) AS gap, count(*) OVER (PARTITION BY cs, ct) AS k FROM m)
SELECT source, target, round(gap, 6) AS obstruction, round(exp(-gap), 6) AS compatibility, round(k / (SELECT count(*) FROM g), 6) AS frequency, CASE WHEN cs <> ct THEN 1 ELSE 0 END AS boundary FROM g""")
def sheaf_obstruction(spark, sf):
    m = graph.margin(T.trade_top(spark, sf)).withColumn("margin", F.col("margin") / 1000.0)
    charts = _regions(spark, sf).withColumnRenamed("module", "chart")
    return support.obstruction(m, charts).select("source", "target", *r6("obstruction", "compatibility", "frequency"), "boundary")


# models on columns


@query("""WITH d AS (SELECT o_orderpriority AS g, o_totalprice / 1000.0 AS x, count(*) * 1.0 AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_totalprice),
f AS (SELECT a.g, b.m, b.c FROM (SELECT DISTINCT g FROM d) a, LATERAL (SELECT regr_slope(y, x) AS m, regr_intercept(y, x) AS c FROM d WHERE d.g <> a.g) b)
SELECT g, count(*) AS n, round(1 - sum((y - m * x - c) * (y - m * x - c)) / (var_pop(y) * count(*)), 5) AS r2 FROM d JOIN f USING (g) GROUP BY g""")
def leave_group_out_r2(spark, sf):
    return models.leave_group_out_r2(_order_lines(spark, sf), "x", "y", "g").select("g", "n", F.round("r2", 5).alias("r2"))


def _order_lines(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    n = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("y"))
    o = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000.0).alias("x"))
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("g", "x", "y")


@query("""WITH d AS (SELECT o_totalprice / 1000.0 AS x, count(*) * 1.0 AS y FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice),
q AS (SELECT quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.9) AS b FROM d), p AS (SELECT x, 40.0 * y AS p, a, b FROM d, q),
c AS (SELECT *, least(greatest(x, a), b) AS cx, least(greatest(p, a), b) AS cp, x BETWEEN a AND b AS i FROM p)
SELECT round(1 - sum((x - p) * (x - p)) / (var_pop(x) * count(*)), 5) AS r2, round(1 - sum((cx - cp) * (cx - cp)) / (var_pop(cx) * count(*)), 5) AS winsorized_r2,
       round(1 - sum(CASE WHEN i THEN (x - p) * (x - p) END) / (var_pop(CASE WHEN i THEN x END) * count(CASE WHEN i THEN x END)), 5) AS trimmed_r2 FROM c""")
def winsorized_r2(spark, sf):
    d = _order_lines(spark, sf).select("x", (40.0 * F.col("y")).alias("p"))
    return models.robust_r2(d, "x", "p").select(*[F.round(c, 5).alias(c) for c in ("r2", "winsorized_r2", "trimmed_r2")])


@query("""WITH d AS (SELECT user_id % 7 AS k, epoch(date_trunc('day', ts)) / 86400.0 AS x, avg(value) AS y FROM events GROUP BY ALL), l AS (SELECT k, min(x) AS lo, max(x) AS hi FROM d GROUP BY k),
c AS (SELECT DISTINCT d.k, x AS cut FROM d JOIN l ON d.k = l.k WHERE x > lo AND x < hi),
s AS (SELECT d.k, cut, regr_syy(y, x) FILTER (x <= cut) - coalesce(pow(regr_sxy(y, x) FILTER (x <= cut), 2) / nullif(regr_sxx(y, x) FILTER (x <= cut), 0), 0)
   + regr_syy(y, x) FILTER (x >= cut) - coalesce(pow(regr_sxy(y, x) FILTER (x >= cut), 2) / nullif(regr_sxx(y, x) FILTER (x >= cut), 0), 0) AS sse,
   regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS line FROM d JOIN c ON d.k = c.k GROUP BY d.k, cut)
SELECT k, round(arg_min(cut, (round(sse, 7), cut)), 3) AS breakpoint, round(min(sse), 3) AS sse, round(min(line), 3) AS sse_line FROM s GROUP BY k""")
def linear_breakpoint(spark, sf):
    e = T.table(spark, sf, "events").withColumn("x", F.unix_timestamp(F.date_trunc("day", "ts")) / 86400.0)
    d = e.groupBy((F.col("user_id") % 7).alias("k"), "x").agg(F.avg("value").alias("y"))
    return models.best_breakpoint(d, "x", "y", ["k"]).select("k", *[F.round(c, 3).alias(c) for c in ("breakpoint", "sse", "sse_line")])


# sequences


@query(f"WITH {TOKENS}, c AS (SELECT user_id, h1, token, count(*) AS n FROM steps WHERE h1 IS NOT NULL GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c GROUP BY user_id")
def transition_entropy(spark, sf):
    return sequences.transition_entropy(T.event_tokens(spark, sf)).select("user_id", "n", *r6("entropy"))


def _odds_sql(h: str, order: int) -> str:
    return f"""WITH {TOKENS}, u AS (SELECT user_id, CASE WHEN avg(value) > (SELECT avg(value) FROM events) THEN 1 ELSE 0 END AS y FROM events GROUP BY user_id),
c AS (SELECT {h}, token, sum(y) AS p, sum(1 - y) AS q FROM steps JOIN u USING (user_id) WHERE h{order} IS NOT NULL GROUP BY ALL)
SELECT {h}, token, CAST(p AS BIGINT) AS p, CAST(q AS BIGINT) AS q, round(ln((p + 1.0) / (sum(p) OVER (PARTITION BY {h}) + 5.0)) - ln((q + 1.0) / (sum(q) OVER (PARTITION BY {h}) + 5.0)), 6) AS log_odds FROM c"""


def _user_labels(spark, sf):
    e = T.table(spark, sf, "events")
    mean = e.agg(F.avg("value").alias("m"))
    return e.groupBy("user_id").agg(F.avg("value").alias("v")).crossJoin(F.broadcast(mean)).select("user_id", (F.col("v") > F.col("m")).cast("int").alias("label"))


@query(_odds_sql("h1", 1))
def transition_logodds(spark, sf):
    steps = sequences.transitions(T.event_tokens(spark, sf)).join(_user_labels(spark, sf), "user_id")
    return sequences.log_odds(steps, ["h1"], "label", 5).select("h1", "token", "p", "q", *r6("log_odds"))


@query(_odds_sql("h1, h2", 2))
def second_order_logodds(spark, sf):
    steps = sequences.transitions(T.event_tokens(spark, sf), order=2).join(_user_labels(spark, sf), "user_id")
    return sequences.log_odds(steps, ["h1", "h2"], "label", 5).select("h1", "h2", "token", "p", "q", *r6("log_odds"))


@query(f"""WITH {TOKENS}, g AS (SELECT user_id, token, pos - row_number() OVER (PARTITION BY user_id, token ORDER BY pos) AS k FROM tokens), r AS (SELECT user_id, token, count(*) AS n FROM g GROUP BY user_id, token, k)
SELECT token, CAST(least(n - 1, 2) AS INTEGER) AS dwell, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_tokens FROM r GROUP BY ALL""")
def segment_dwell(spark, sf):
    s = sequences.segments(T.event_tokens(spark, sf))
    return s.groupBy("token", "dwell").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("length").alias("n_tokens"))


@query(f"""WITH {TOKENS}, u AS (SELECT user_id, CASE WHEN avg(value) > (SELECT avg(value) FROM events) THEN 1 ELSE 0 END AS y FROM events GROUP BY user_id),
f AS (SELECT user_id, y, (row_number() OVER (PARTITION BY y ORDER BY md5(user_id || '|fold'), user_id) - 1) % 3 AS fold FROM u),
s AS (SELECT user_id, fold, y, h1, token FROM steps JOIN f USING (user_id) WHERE h1 IS NOT NULL), k AS (SELECT DISTINCT fold FROM f),
o AS (SELECT fold, h1, token, sum(y) AS p, sum(1 - y) AS q FROM s GROUP BY ALL), t AS (SELECT h1, token, sum(p) AS tp, sum(q) AS tq FROM o GROUP BY ALL),
g AS (SELECT k.fold, t.h1, t.token, tp - coalesce(p, 0) AS p, tq - coalesce(q, 0) AS q FROM t CROSS JOIN k LEFT JOIN o ON o.fold = k.fold AND o.h1 = t.h1 AND o.token = t.token),
m AS (SELECT fold, h1, token, ln((p + 1.0) / (sum(p) OVER w + 5.0)) - ln((q + 1.0) / (sum(q) OVER w + 5.0)) AS odds FROM g WINDOW w AS (PARTITION BY fold, h1)),
z AS (SELECT user_id, sum(odds) AS score FROM s JOIN m USING (fold, h1, token) GROUP BY user_id)
SELECT f.user_id, y AS label, CAST(fold AS INTEGER) AS fold, round(coalesce(score, 0), 6) AS score FROM f LEFT JOIN z USING (user_id)""")
def sequence_cv_scores(spark, sf):
    labels = R.folds(_user_labels(spark, sf), 3, "user_id", "label", "fold")
    return sequences.cross_fitted_scores(T.event_tokens(spark, sf), labels).select("user_id", "label", F.col("fold").cast("int").alias("fold"), *r6("score"))


@query(f"""WITH {TOKENS}, c AS (SELECT user_id, token, lag(token) OVER (PARTITION BY user_id ORDER BY pos) AS h FROM tokens)
SELECT user_id, array_to_string(list_sort(list(token)), ',') AS bag, CAST(sum(CASE WHEN h <> token THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM c GROUP BY user_id""")
def sequence_signature(spark, sf):
    return sequences.signature(T.event_tokens(spark, sf)).select("user_id", F.concat_ws(",", "bag").alias("bag"), "changes")


# topology


PAIRS = """pairs AS (SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, sum(w) AS w FROM (SELECT least(source, target) AS u, greatest(source, target) AS v, w FROM trade WHERE source <> target) GROUP BY ALL)"""


def _trade_pairs(spark, sf):
    e = T.trade(spark, sf).where("source <> target").groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.sum("w").alias("w"))
    return e.select("u", "v", (1000.0 / F.col("w")).alias("distance"), F.col("w").cast("double").alias("support"))


@query(f"""WITH RECURSIVE {TRADE}, {PAIRS}, c AS (SELECT unnest(q) AS cut, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS level FROM (SELECT quantile_cont(1000.0 / w, [0.025, 0.05, 0.075, 0.1]) AS q FROM pairs)),
f AS (SELECT level, u, v FROM pairs, c WHERE 1000.0 / w <= cut), b AS (SELECT level, u AS a, v AS b FROM f UNION ALL SELECT level, v, u FROM f),
n AS (SELECT level, CAST(n_nationkey AS INTEGER) AS node FROM nation, (SELECT CAST(unnest(range(4)) AS INTEGER) AS level)),
r AS (SELECT level, node, node AS root FROM n UNION SELECT r.level, b.b, r.root FROM r JOIN b ON r.level = b.level AND r.node = b.a),
k AS (SELECT level, count(DISTINCT root) AS betti0, count(DISTINCT node) AS n_nodes FROM (SELECT level, node, min(root) AS root FROM r GROUP BY ALL) GROUP BY level)
SELECT level, betti0, n_nodes, greatest(0, (SELECT count(*) FROM f WHERE f.level = k.level) - n_nodes + betti0) AS betti1 FROM k""")
def cycle_rank_curve(spark, sf):
    nodes = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return topology.betti_curve(_trade_pairs(spark, sf), nodes, [(k + 1) / 40.0 for k in range(4)]).select("level", "betti0", "n_nodes", "betti1")


@query(f"""WITH {TRADE}, {PAIRS}, d AS (SELECT unnest(q) AS cut, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS level FROM (SELECT quantile_cont(1000.0 / w, [0.1, 0.3]) AS q FROM pairs)),
s AS (SELECT unnest(q) AS s_cut, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS s_level FROM (SELECT quantile_cont(CAST(w AS DOUBLE), [0.5, 0.8]) AS q FROM pairs))
SELECT level, s_level, count(*) AS n_edges, CAST(sum(u * 31 + v) AS BIGINT) AS check_sum FROM pairs, d, s WHERE 1000.0 / w <= cut AND w >= s_cut GROUP BY ALL""")
def bifiltration_edges(spark, sf):
    f = topology.bifiltration(_trade_pairs(spark, sf), [0.1, 0.3], [0.5, 0.8])
    return f.groupBy("level", "s_level").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("u") * 31 + F.col("v")).alias("check_sum"))


@query(f"""WITH RECURSIVE {TRADE}, {PAIRS}, d AS (SELECT unnest(q) AS cut, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS level FROM (SELECT quantile_cont(1000.0 / w, [0.05, 0.1]) AS q FROM pairs)),
s AS (SELECT unnest(q) AS s_cut, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS s_level FROM (SELECT quantile_cont(CAST(w AS DOUBLE), [0.9, 0.95]) AS q FROM pairs)),
f AS (SELECT level, s_level, u, v FROM pairs, d, s WHERE 1000.0 / w <= cut AND w >= s_cut), b AS (SELECT level, s_level, u AS a, v AS b FROM f UNION ALL SELECT level, s_level, v, u FROM f),
n AS (SELECT level, s_level, CAST(n_nationkey AS INTEGER) AS node FROM nation, d, s),
r AS (SELECT level, s_level, node, node AS root FROM n UNION SELECT r.level, r.s_level, b.b, r.root FROM r JOIN b ON r.level = b.level AND r.s_level = b.s_level AND r.node = b.a),
k AS (SELECT level, s_level, count(DISTINCT root) AS betti0, count(*) AS n_nodes FROM (SELECT level, s_level, node, min(root) AS root FROM r GROUP BY ALL) GROUP BY ALL)
SELECT level, s_level, betti0, greatest(0, (SELECT count(*) FROM f WHERE f.level = k.level AND f.s_level = k.s_level) - n_nodes + betti0) AS betti1 FROM k""")
def bifiltration_connectivity(spark, sf):
    nodes = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return topology.bifiltration_curve(_trade_pairs(spark, sf), nodes, [0.05, 0.1], [0.9, 0.95])


@query(f"""WITH RECURSIVE {KNN}, f AS (SELECT layer, u, v FROM knn_edges WHERE distance <= (SELECT quantile_cont(distance, 0.02) FROM knn_edges)),
b AS (SELECT layer, u AS a, v AS b FROM f UNION ALL SELECT layer, v, u FROM f),
r AS (SELECT layer, a AS node, a AS root FROM b UNION SELECT r.layer, b.b, r.root FROM r JOIN b ON r.layer = b.layer AND r.node = b.a)
SELECT layer, node, min(root) AS component FROM r GROUP BY ALL""")
def connected_components(spark, sf):
    e = _edges(spark, sf)
    cut = e.agg(F.percentile("distance", F.lit(0.02)).alias("cut"))
    return graph.components(e.crossJoin(F.broadcast(cut)).where("distance <= cut").select("layer", "u", "v"), ["layer"])


# nulls, calibration and screens


@query(f"""WITH {SCORED}, k AS (SELECT unnest(range(5)) AS perm_idx), a AS (SELECT perm_idx, lang, doc_id, row_number() OVER (PARTITION BY perm_idx, lang ORDER BY doc_id) AS r FROM scored, k),
b AS (SELECT perm_idx, lang, quality, row_number() OVER (PARTITION BY perm_idx, lang ORDER BY md5(doc_id || '|' || perm_idx || '|null'), doc_id) AS r FROM scored, k)
SELECT CAST(a.perm_idx AS INTEGER) AS perm_idx, doc_id, quality AS quality_perm FROM a JOIN b USING (perm_idx, lang, r)""")
def stratified_perm_null(spark, sf):
    d = R.replicates(T.scored_documents(spark, sf).select("doc_id", "lang", "quality"), 5)
    return R.permuted(d, ["quality"], "doc_id", "null", ["lang"], "perm_idx").select("perm_idx", "doc_id", "quality_perm")


@query(f"""WITH {SCORED}, k AS (SELECT unnest(range(5)) AS perm_idx),
a AS (SELECT perm_idx, lang, doc_id, 1 + CAST('0x' || substr(md5(doc_id || '|' || perm_idx || '|boot'), 1, 13) AS BIGINT) % count(*) OVER (PARTITION BY perm_idx, lang) AS r FROM scored, k),
b AS (SELECT perm_idx, lang, n_chars, row_number() OVER (PARTITION BY perm_idx, lang ORDER BY doc_id) AS r FROM scored, k),
m AS (SELECT perm_idx, lang, avg(n_chars) AS m FROM a JOIN b USING (perm_idx, lang, r) GROUP BY ALL)
SELECT lang, round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m GROUP BY lang""")
def bootstrap_ci(spark, sf):
    d = R.replicates(T.scored_documents(spark, sf).select("doc_id", "lang", "n_chars"), 5)
    m = R.resampled(d, ["n_chars"], "doc_id", "boot", ["lang"], "perm_idx").groupBy("perm_idx", "lang").agg(F.avg("n_chars_boot").alias("m"))
    return m.groupBy("lang").agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 4).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 4).alias("high"))


@query(f"""WITH {SCORED}, s AS (SELECT doc_id, lang, n_chars, CASE WHEN CAST('0x' || substr(md5(doc_id || '|coin'), 1, 13) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS c FROM scored)
SELECT lang, count(*) AS n, round(avg(c * n_chars), 4) AS flipped_mean FROM s GROUP BY lang""")
def sign_flip_null(spark, sf):
    d = T.scored_documents(spark, sf).withColumn("c", R.coin("doc_id", salt="coin"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("c") * F.col("n_chars")), 4).alias("flipped_mean"))


EDGES = POINTS + """, nodes AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS spot FROM embeddings), aimed AS (
  SELECT vec_id AS a, CAST('0x' || substr(md5(vec_id || '|' || draw || '|edge'), 1, 13) AS BIGINT) % (SELECT count(*) FROM nodes) AS spot FROM nodes, (SELECT unnest(range(8)) AS draw)),
partner AS (SELECT DISTINCT least(a, vec_id) AS u, greatest(a, vec_id) AS v FROM aimed JOIN nodes USING (spot) WHERE a <> vec_id),
far AS (SELECT p.u, p.v, CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS y, x.label % 3 AS domain, x.layer, list_distance(x.vec, y.vec) AS distance
  FROM partner p JOIN points x ON p.u = x.vec_id JOIN points y ON p.v = y.vec_id AND x.layer = y.layer),
med AS (SELECT quantile_cont(u, 0.5) AS mu, quantile_cont(v, 0.5) AS mv FROM far),
edges AS (SELECT 'source_disjoint' AS split, far.* FROM far, med WHERE u <= mu UNION ALL SELECT 'target_disjoint', far.* FROM far, med WHERE v > mv UNION ALL SELECT 'dual_axis', far.* FROM far, med WHERE u <= mu AND v > mv),
seen AS (""" + auc_sql("edges", "domain, split, layer", "y", "round(-distance, 9)") + ")"
NULLS = EDGES + """, rep AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS perm_idx), place AS (SELECT perm_idx, domain, split, layer, distance, row_number() OVER (PARTITION BY perm_idx, domain, split, layer ORDER BY u || '-' || v) AS r FROM edges, rep),
mover AS (SELECT perm_idx, domain, split, layer, y, row_number() OVER (PARTITION BY perm_idx, domain, split, layer ORDER BY md5(u || '-' || v || '|' || perm_idx || '|label_permutation'), u || '-' || v) AS r FROM edges, rep),
moved AS (SELECT * FROM place JOIN mover USING (perm_idx, domain, split, layer, r)), nulls AS (""" + auc_sql("moved", "domain, split, layer, perm_idx", "y", "round(-distance, 9)") + ")"


@query(f"WITH {EDGES} SELECT domain, split, layer, round(auc, 6) AS auc FROM seen")
def distance_auc(spark, sf):
    p = T.points(spark, sf)
    return screen.observed_auc(screen.labelled_edges(p, T.whole_points(spark, sf))).select("domain", "split", "layer", *r6("auc"))


@query(f"WITH {NULLS} SELECT domain, split, layer, perm_idx, round(auc, 6) AS null_value FROM nulls")
def label_perm_null(spark, sf):
    p = T.points(spark, sf)
    n = screen.null_auc(screen.labelled_edges(p, T.whole_points(spark, sf)), 20, "label_permutation")
    return n.select("domain", "split", "layer", "perm_idx", *r6("null_value"))


@query(f"""WITH {NULLS}, c AS (SELECT s.domain, s.split, s.layer, s.auc AS observed, avg(n.auc) AS m, quantile_cont(n.auc, 0.95) AS q, (1.0 + count(CASE WHEN n.auc >= s.auc THEN 1 END)) / (1 + count(n.auc)) AS p
  FROM seen s JOIN nulls n ON s.domain = n.domain AND s.split = n.split AND s.layer = n.layer GROUP BY ALL)
SELECT split, layer, count(*) AS n_rows, round(avg(observed - m), 6) AS mean_delta, round(avg(observed - q), 6) AS mean_gap, round(avg(CASE WHEN observed > m THEN 1.0 ELSE 0.0 END), 6) AS share_delta_positive,
       round(avg(CASE WHEN observed > q THEN 1.0 ELSE 0.0 END), 6) AS share_gap_positive, round(exp(sum(ln(p))) * (1 - sum(ln(p)) + pow(sum(ln(p)), 2) / 2), 6) AS fisher_p FROM c GROUP BY split, layer""")
def distance_screen(spark, sf):
    rows = screen.fisher_summary(T.points(spark, sf), T.whole_points(spark, sf))
    return rows.select("split", "layer", "n_rows", *r6("mean_delta", "mean_gap", "share_delta_positive", "share_gap_positive", "fisher_p"))


@query(f"""WITH {SCORED}, r AS (SELECT lang, source, avg(quality) - avg(toxic) AS delta FROM scored GROUP BY ALL),
n AS (SELECT s.lang, CASE WHEN k % 2 = 0 THEN 'alpha' ELSE 'beta' END AS null_kind, k AS perm_idx, avg(CASE WHEN CAST('0x' || substr(md5(doc_id || '|' || k || '|kind'), 1, 13) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END * quality) AS null_value FROM scored s, (SELECT unnest(range(20)) AS k) GROUP BY ALL),
q AS (SELECT lang, max(CASE WHEN null_kind = 'alpha' THEN q END) AS alpha_q95, max(CASE WHEN null_kind = 'beta' THEN q END) AS beta_q95 FROM (SELECT lang, null_kind, quantile_cont(null_value, 0.95) AS q FROM n GROUP BY ALL) GROUP BY lang)
SELECT lang, source, round(delta, 6) AS delta, round(delta - alpha_q95, 6) AS margin_vs_alpha, round(delta - beta_q95, 6) AS margin_vs_beta, round(delta - greatest(alpha_q95, beta_q95), 6) AS strict_margin,
       CASE WHEN delta > greatest(alpha_q95, beta_q95) THEN 1 ELSE 0 END AS strict_positive FROM r JOIN q USING (lang)""")
def strict_max_null_audit(spark, sf):
    d = T.scored_documents(spark, sf)
    results = d.groupBy("lang", "source").agg((F.avg("quality") - F.avg("toxic")).alias("delta"))
    many = R.replicates(d, 20).withColumn("null_kind", F.when(F.col("perm_idx") % 2 == 0, "alpha").otherwise("beta"))
    nulls = many.groupBy("lang", "null_kind", "perm_idx").agg(F.avg(R.coin("doc_id", "perm_idx", salt="kind") * F.col("quality")).alias("null_value"))
    out = audit.strict_audit(results, nulls, ["lang"], ["alpha", "beta"])
    return out.select("lang", "source", *r6("delta", "margin_vs_alpha", "margin_vs_beta", "strict_margin"), "strict_positive")


@query(f"""WITH {SCORED}, r AS (SELECT lang, source, avg(quality) - avg(toxic) AS delta, avg(quality) - 0.5 AS null_gap, (1.0 + sum(toxic)) / (2 + count(*)) AS p FROM scored GROUP BY ALL)
SELECT lang, source, count(*) AS n_rows, round(avg(delta), 6) AS mean_delta, round(avg(null_gap), 6) AS mean_gap, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_delta_positive,
       round(-2 * sum(ln(greatest(1e-12, p))), 5) AS fisher_stat FROM r GROUP BY GROUPING SETS ((lang, source), (lang))""")
def domain_split_summary(spark, sf):
    d = T.scored_documents(spark, sf).groupBy("lang", "source").agg((F.avg("quality") - F.avg("toxic")).alias("delta"), (F.avg("quality") - 0.5).alias("null_gap"), ((1.0 + F.sum("toxic")) / (2 + F.count(F.lit(1)))).alias("p"))
    g = d.groupingSets([[F.col("lang"), F.col("source")], [F.col("lang")]], "lang", "source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("delta").alias("mean_delta"), F.avg("null_gap").alias("mean_gap"), F.avg((F.col("delta") > 0).cast("double")).alias("share_delta_positive"), S.fisher_stat("p").alias("fisher_stat"))
    return g.select("lang", "source", "n_rows", *r6("mean_delta", "mean_gap", "share_delta_positive"), F.round("fisher_stat", 5).alias("fisher_stat"))


@query(f"""WITH {SCORED}, p AS (SELECT source, (1.0 + sum(toxic)) / (1 + count(*)) AS p, substr(source, 1, 4) AS g FROM scored GROUP BY source)
SELECT g, count(*) AS n, round(-2 * sum(ln(greatest(1e-12, least(1.0, p)))), 6) AS fisher_stat FROM p GROUP BY g""")
def fisher_combine(spark, sf):
    p = T.scored_documents(spark, sf).groupBy("source").agg(((1.0 + F.sum("toxic")) / (1 + F.count(F.lit(1)))).alias("p"))
    return p.groupBy(F.substring("source", 1, 4).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.round(S.fisher_stat("p"), 6).alias("fisher_stat"))


@query(f"""WITH {SCORED} SELECT lang, count(*) AS n, min(n_chars) AS low, quantile_cont(n_chars, 0.25) AS q25, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q75, max(n_chars) AS high FROM scored GROUP BY lang""")
def box_stats(spark, sf):
    return audit.box_stats(T.scored_documents(spark, sf), "n_chars", ["lang"])


@query("""WITH d AS (SELECT conv_id, turn, role, CASE WHEN length(text) % 3 = 0 THEN 'negative' WHEN length(text) % 3 = 1 THEN 'inconclusive' ELSE 'promising' END AS decision FROM conversations),
n AS (SELECT DISTINCT conv_id FROM d ORDER BY conv_id DESC LIMIT 8)
SELECT role AS family, count(*) AS n_weak FROM d JOIN n USING (conv_id) WHERE decision IN ('negative', 'inconclusive') GROUP BY role HAVING count(*) >= 2""")
def decision_history(spark, sf):
    r = F.char_length("text") % 3
    d = T.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("iteration"), F.col("turn").alias("id"), F.col("role").alias("family"), F.when(r == 0, "negative").when(r == 1, "inconclusive").otherwise("promising").alias("decision"))
    return audit.decision_history(d)[1]


# geometry: kernels a slice, without counterpart in SQL


def _label_edges(spark, sf):
    """Partner edges inside each label and layer, y: nearer than the slice's median in the last layer."""
    p = T.points(spark, sf)
    nodes = p.where("layer = 0").select("vec_id", "label")
    n = Window.partitionBy("label")
    numbered = nodes.withColumn("at", F.row_number().over(n.orderBy("vec_id")) - 1).withColumn("size", F.count(F.lit(1)).over(n))
    aimed = R.replicates(numbered, 6, "draw").select("label", F.col("vec_id").alias("a"), (R.number("vec_id", "draw", salt="in") % F.col("size")).alias("at"))
    e = aimed.join(numbered.select("label", "at", F.col("vec_id").alias("b")), ["label", "at"]).where("a <> b").select("label", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    last = vectors.edge_vectors(e, p.where("layer = 3"), ["label"]).select("label", "u", "v", X.distance("x", "y").alias("d"))
    cut = last.groupBy("label").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    y = last.join(F.broadcast(cut), "label").select("label", "u", "v", (F.col("d") < F.col("m")).cast("int").alias("y"))
    return p, y.crossJoin(F.broadcast(p.select("layer").distinct()))


LABELLED = POINTS + """, lnodes AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS at, count(*) OVER (PARTITION BY label) AS size FROM embeddings),
laimed AS (SELECT label, vec_id AS a, CAST('0x' || substr(md5(vec_id || '|' || draw || '|in'), 1, 13) AS BIGINT) % size AS at FROM lnodes, (SELECT unnest(range(6)) AS draw)),
lpairs AS (SELECT DISTINCT l.label, least(a, n.vec_id) AS u, greatest(a, n.vec_id) AS v FROM laimed l JOIN lnodes n ON l.label = n.label AND l.at = n.at WHERE a <> n.vec_id),
llast AS (SELECT e.label, u, v, list_distance(x.vec, y.vec) AS d FROM lpairs e JOIN points x ON x.vec_id = u AND x.layer = 3 JOIN points y ON y.vec_id = v AND y.layer = 3),
lmed AS (SELECT label, quantile_cont(d, 0.5) AS m FROM llast GROUP BY label),
ledges AS (SELECT l.label, u, v, CASE WHEN d < m THEN 1 ELSE 0 END AS y, layer FROM llast l JOIN lmed ON l.label = lmed.label, (SELECT CAST(unnest(range(4)) AS INTEGER) AS layer))"""
CLOUDS = """spots AS (SELECT label, layer, vec_id, vec, row_number() OVER (PARTITION BY label, layer ORDER BY vec_id) AS r FROM points),
kn AS (SELECT * FROM (SELECT a.label, a.layer, a.r AS i, b.r AS j, list_distance(a.vec, b.vec) AS w, row_number() OVER (PARTITION BY a.label, a.layer, a.vec_id ORDER BY list_distance(a.vec, b.vec), b.vec_id) AS q
  FROM spots a JOIN spots b ON a.label = b.label AND a.layer = b.layer AND a.r <> b.r) WHERE q <= 12),
near AS (SELECT label, layer, least(i, j) AS i, greatest(i, j) AS j, min(w) AS w, row_number() OVER (PARTITION BY label, layer ORDER BY min(w), least(i, j), greatest(i, j)) AS place FROM kn GROUP BY label, layer, least(i, j), greatest(i, j))"""


def _closure(weight: str, joined: str) -> str:
    """SQL of the least length of a way between any two points of a slice, over more and more of the points, where
    the lengths b.d and c.d of two parts of a way are joined to one."""
    return f"""arcs AS (SELECT label, layer, i, j, CAST({weight} AS DOUBLE) AS w FROM near UNION ALL SELECT label, layer, j, i, {weight} FROM near),
ways AS (
  SELECT CAST(0 AS BIGINT) AS k, a.label, a.layer, a.r AS i, b.r AS j, CASE WHEN a.r = b.r THEN 0.0 ELSE coalesce(w, 'inf'::DOUBLE) END AS d
  FROM spots a JOIN spots b ON a.label = b.label AND a.layer = b.layer LEFT JOIN arcs ON arcs.label = a.label AND arcs.layer = a.layer AND arcs.i = a.r AND arcs.j = b.r
  UNION ALL
  SELECT a.k + 1, a.label, a.layer, a.i, a.j, least(a.d, coalesce({joined}, 'inf'::DOUBLE)) FROM ways a
  LEFT JOIN ways b ON b.label = a.label AND b.layer = a.layer AND b.i = a.i AND b.j = a.k + 1 LEFT JOIN ways c ON c.label = a.label AND c.layer = a.layer AND c.i = a.k + 1 AND c.j = a.j
  WHERE a.k < (SELECT max(r) FROM spots)),
closed AS (SELECT w.label, w.layer, a.vec_id AS u, b.vec_id AS v, list_distance(a.vec, b.vec) AS euclidean, d FROM ways w
  JOIN spots a ON w.label = a.label AND w.layer = a.layer AND w.i = a.r JOIN spots b ON w.label = b.label AND w.layer = b.layer AND w.j = b.r WHERE k = (SELECT max(r) FROM spots))"""


GEODESIC = "WITH RECURSIVE " + LABELLED + ", " + CLOUDS + ", " + _closure("w", "b.d + c.d")
FOREST = "WITH RECURSIVE " + POINTS + ", " + CLOUDS + ", " + _closure("place", "greatest(b.d, c.d)") + """, forest AS (
  SELECT n.label, n.layer, u, v, w FROM near n JOIN spots a ON n.label = a.label AND n.layer = a.layer AND n.i = a.r JOIN spots b ON n.label = b.label AND n.layer = b.layer AND n.j = b.r
  JOIN closed c ON c.label = n.label AND c.layer = n.layer AND c.u = a.vec_id AND c.v = b.vec_id WHERE c.d = n.place)"""


@query(f"""{GEODESIC}, e AS (SELECT l.*, -euclidean AS a, -d AS b FROM ledges l JOIN closed c ON l.label = c.label AND l.layer = c.layer AND l.u = c.u AND l.v = c.v),
x AS ({auc_sql("e", "label, layer", "y", "a")}), z AS ({auc_sql("e", "label, layer", "y", "b")}), s AS (SELECT label, layer, count(*) AS n FROM e GROUP BY ALL)
SELECT s.label, s.layer, n, CASE WHEN n >= 40 THEN round(z.auc - x.auc, 6) END AS delta_auc FROM s JOIN x ON s.label = x.label AND s.layer = x.layer JOIN z ON s.label = z.label AND s.layer = z.layer""")
def geodesic_delta(spark, sf):
    """AUC of geodesic less that of Euclidean distance, per layer and label."""
    p, e = _label_edges(spark, sf)
    g = paths.edge_geodesics(p, e, ["label", "layer"]).join(e, ["label", "layer", "u", "v"])
    g = g.withColumn("a", -F.col("euclidean")).withColumn("b", -F.col("geodesic"))
    return models.subset_delta_auc(g, "y", "a", "b", ["label", "layer"]).select("label", "layer", "n", *r6("delta_auc"))


@query(f"{GEODESIC} SELECT l.label, l.layer, l.u, l.v, round(euclidean, 6) AS euclidean, round(d, 6) AS geodesic FROM ledges l JOIN closed c ON l.label = c.label AND l.layer = c.layer AND l.u = c.u AND l.v = c.v")
def geodesic_lengths(spark, sf):
    """Shortest paths over the neighbour graph from the ends of labelled edges."""
    p, e = _label_edges(spark, sf)
    return paths.edge_geodesics(p, e, ["label", "layer"]).select("label", "layer", "u", "v", *r6("euclidean", "geodesic"))


@query(FOREST + " SELECT label, layer, u, v, round(w, 6) AS w FROM forest")
def spanning_forest(spark, sf):
    """The lightest spanning forest of each slice's neighbour graph."""
    return paths.spanning_forest(_near_graph(spark, sf), ["label", "layer"]).select("label", "layer", "u", "v", *r6("w"))


@query(FOREST + """, ended AS (SELECT label, layer, count(*) AS bars, round(sum(w), 5) AS total, round(max(w), 6) AS longest FROM forest GROUP BY ALL), n AS (SELECT label, layer, count(*) AS n FROM spots GROUP BY ALL)
SELECT n.label, n.layer, bars, n - bars AS endless, total, longest FROM n JOIN ended ON n.label = ended.label AND n.layer = ended.layer""")
def zero_bars(spark, sf):
    """Bars of connected parts of each slice: how many end, how many don't, their total and longest."""
    keys = ["label", "layer"]
    bars = paths.zero_bars(paths.spanning_forest(_near_graph(spark, sf), keys), T.points(spark, sf), keys)
    return bars.groupBy(*keys).agg(F.count("death").alias("bars"), F.count_if(F.col("death").isNull()).alias("endless"), F.round(F.sum("death"), 5).alias("total"), F.round(F.max("death"), 6).alias("longest"))


def _near_graph(spark, sf):
    p = T.points(spark, sf)
    return vectors.knn_edges(vectors.knn(p, 12, ["label", "layer"]), ["label", "layer"]).select("label", "layer", "u", "v", F.col("distance").alias("w"))


@query(f"""WITH {LABELLED}, e AS (
  SELECT l.label, l.layer, l.u, l.v, x.vec AS a, z.vec AS b, list_transform(list_zip(x.vec, z.vec), lambda t: t[2] - t[1]) AS w FROM ledges l JOIN points x ON x.vec_id = l.u AND x.layer = l.layer JOIN points z ON z.vec_id = l.v AND z.layer = l.layer),
d AS (SELECT *, sqrt(list_dot_product(w, w)) AS len, abs(a[1] - b[1]) AS apart, (a[1] + b[1]) / 2 AS mean, a[4] - b[4] AS margin FROM e)
SELECT label, layer, u, v, round(apart, 6) AS anisotropy_apart, round(mean, 6) AS anisotropy_mean, round((a[2] + b[2]) / 2, 6) AS planarity_mean, round((a[3] + b[3]) / 2, 6) AS omnivariance_mean, round(margin, 6) AS margin,
  round(abs(list_dot_product(w, a)) / len, 6) AS align_u, round(abs(list_dot_product(w, b)) / len, 6) AS align_v, round(abs(list_dot_product(a, b)), 6) AS align_pair,
  round(apart * margin, 6) AS apart_margin, round(mean * abs(list_dot_product(a, b)), 6) AS mean_pair FROM d""")
def section_columns(spark, sf):
    """The columns of the sectional screens where a point's first parts stand for its shape and the point itself for its axis."""
    p, e = _label_edges(spark, sf)
    rows = vectors.edge_vectors(e.select("label", "layer", "u", "v"), p, ["label", "layer"])
    shape = {f"{c}_{end}": F.col(vec)[i] for end, vec in (("u", "x"), ("v", "y")) for i, c in enumerate(("anisotropy", "planarity", "omnivariance"))}
    rows = rows.withColumns(shape | {"axis_u": F.col("x"), "axis_v": F.col("y"), "margin": F.col("x")[3] - F.col("y")[3], "way": X.unit(F.zip_with("y", "x", lambda a, b: a - b))})
    names = [c.split()[0] for c in geometry.SECTION if not c.startswith(("anisotropy_u", "anisotropy_v"))]
    return geometry.section_columns(rows).select("label", "layer", "u", "v", *r6(*names))


@query()
def base_score_auc(spark, sf):
    p, e = _label_edges(spark, sf)
    g = geometry.spread_geometry(p, e, ["label", "layer"]).join(e, ["label", "layer", "u", "v"])
    return S.auc(g, "y", "base_score", ["label", "layer"]).select("label", "layer", *r6("auc"))


@query(f"""{GEODESIC}, s AS (SELECT label, layer, count(*) AS n FROM spots GROUP BY ALL), m AS (SELECT label, layer, avg(d / euclidean) AS m FROM closed WHERE u < v AND euclidean > 1e-9 GROUP BY ALL)
SELECT s.label, s.layer, n, round(m, 6) AS mean_distortion FROM s LEFT JOIN m ON s.label = m.label AND s.layer = m.layer""")
def geodesic_distortion(spark, sf):
    """Mean of geodesic over Euclidean distance, over all pairs of points of a slice."""
    keys = ["label", "layer"]
    p = T.points(spark, sf)
    means = paths.distortion(p, keys).where("pairs > 0").select(*keys, F.round(F.col("total") / F.col("pairs"), 6).alias("mean_distortion"))
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(means, keys, "left")


@query()
def rips_persistence(spark, sf):
    """First homology around each point, a slice per label and layer."""
    return geometry.local_persistence(T.points(spark, sf), ["label", "layer"], 10).select("label", "layer", "id", *r6("total"))


@query()
def shape_descriptors(spark, sf):
    d = geometry.shape_descriptor(T.points(spark, sf), ["label", "layer"])
    return d.select("label", "layer", *r6(*d.columns[2:]))


@query()
def graph_communities(spark, sf):
    return geometry.communities(T.points(spark, sf), ["label", "layer"])


@query()
def path_torsion(spark, sf):
    p, e = _label_edges(spark, sf)
    t = geometry.path_torsion(p, e, ["label", "layer"])
    return t.select("label", "layer", "u", "v", *r6(*t.columns[4:]))


@query()
def local_shape(spark, sf):
    p = T.points(spark, sf)
    s = vectors.local_shape(vectors.knn(p, 8, ["layer"]), p, ["layer"])
    return s.select("layer", "id", *r6("anisotropy", "planarity", "omnivariance", "residual", "tail_share"))


@query()
def canonical_correlations(spark, sf):
    return alignment.canonical_correlations(_paired(spark, sf), ["layer"]).select("layer", "k", *r6("rho"))


@query()
def procrustes_error(spark, sf):
    return alignment.procrustes_error(_paired(spark, sf), ["layer"]).select("layer", *r6("nuclear", "rmse"))


@query()
def cycle_maps(spark, sf):
    return alignment.cycle_maps(_paired(spark, sf), ["layer"]).select("layer", *r6("loss_xy", "loss_yx", "loss_cycle"))


@query()
def transport_alignment(spark, sf):
    c = vectors.centroids(T.points(spark, sf), "label", ["layer"])
    a = c.select("layer", F.col("label").alias("i"), F.col("vec").alias("x"))
    b = c.select((F.col("layer") - 1).alias("layer"), F.col("label").alias("j"), F.col("vec").alias("y"))
    return alignment.transport(a.join(b, "layer").select("layer", "i", "j", X.distance("x", "y").alias("cost")), ["layer"]).select("layer", *r6("cost", "monotone", "matched_cost"))


@query(f"""WITH {KNN}, b AS (SELECT layer, u AS node FROM knn_edges UNION ALL SELECT layer, v FROM knn_edges), n AS (SELECT layer, count(*) AS n_edges FROM knn_edges GROUP BY layer)
SELECT layer, node, count(*) AS degree, any_value(n_edges) AS n_edges, true AS moved FROM b JOIN n USING (layer) GROUP BY ALL""")
def degree_swap_null(spark, sf):
    """Degrees and edges of each layer's graph after rewiring, which are as many as before, though over half
    of the edges are others."""
    e = _edges(spark, sf).select("layer", "u", "v")
    new = rewire.rewired(e, ["layer"])
    same = new.join(e, ["layer", "u", "v"], "left_semi").groupBy("layer").agg(F.count(F.lit(1)).alias("same"))
    whole = new.distinct().groupBy("layer").agg(F.count(F.lit(1)).alias("n_edges")).join(same, "layer", "left")
    stats = whole.select("layer", "n_edges", (2 * F.coalesce("same", F.lit(0)) < F.col("n_edges")).alias("moved"))
    return graph.degrees(new, ["layer"]).join(F.broadcast(stats), "layer")  # a row a slice


@query()
def cv_logit_delta(spark, sf):
    """The model screen: geometry features over the baseline score, with permuted features as null."""
    p, e = _label_edges(spark, sf)
    graph.checkpoints(spark)
    g = geometry.spread_geometry(p, e, ["label", "layer"]).join(e, ["label", "layer", "u", "v"]).checkpoint()
    g = g.withColumn("bin", S.rank_bins("geodesic", 4, ["label", "layer"]))
    seen, nulls = screen.model_screen(g, ["detour", "deficit", "diffusion"], "base_score", "bin", ["label", "layer"])
    out = audit.pooled_gap(seen, nulls, ["label", "layer"])
    return out.select("label", "layer", "n", "n_positive", *r6("auc_base", "auc_model", "delta", "q95_null", "null_gap"))


# one screen of each family, over all slices of labels and layers

REPRESENTATIVES = {
    "manifold": "H136", "graph": "H61", "dimension": "H63", "filtration": "H90", "homology": "H39", "modules": "H118", "transfer": "H62",
}


def _screen(name: str, hypothesis: str):
    def run(spark, sf):
        p, e = _label_edges(spark, sf)
        keys = ("label", "layer")
        other = p.select("label", ((F.col("layer") + 1) % 4).alias("layer"), "vec_id", "vec")
        near = vectors.knn(p, 4, list(keys)).select(*keys, F.col("id").alias("source"), F.col("neighbour").alias("target"), (1 / (1 + F.col("distance"))).alias("support"))
        s = screens.Slices(p.select(*keys, "vec_id", "vec"), e.select(*keys, "u", "v", "y"), keys, near, other)
        out = screens.calibrated(hypothesis, s)
        return out.select(*keys, "n", "n_positive", *r6("auc_base", "auc_model", "delta", "null_gap", "strict_margin"), "strict_positive")

    run.__name__ = f"screen_{name}"
    run.__doc__ = f"The screen {hypothesis}."
    query()(run)


for _name, _hypothesis in REPRESENTATIVES.items():
    _screen(_name, _hypothesis)
