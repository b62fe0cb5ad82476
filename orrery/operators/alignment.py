"""Alignment of two point tables with a common id: Gram sums are aggregated by Spark, the small dense
problem that is left is solved once a slice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expressions as X
from ..functions import random as R
from ..functions.stats import rank_share
from . import kernels as K


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), id_col: str = "vec_id") -> DataFrame:
    """(keys, id, x, y) of the ids in both."""
    return a.select(*keys, F.col(id_col).alias("id"), F.col("vec").alias("x")).join(b.select(*keys, F.col(id_col).alias("id"), F.col("vec").alias("y")), [*keys, "id"])


def gram(pairs: DataFrame, keys: Sequence[str] = (), left: str = "x", right: str = "y", centre: bool = True, weight: str | None = None) -> DataFrame:
    """(keys, i, j, g): sums over rows of left[i] * right[j], about the means if centre."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = pairs.select(*keys, F.posexplode(left).alias("i", "p"), F.col(right), w.alias("w")).select(*keys, "i", "p", "w", F.posexplode(right).alias("j", "q"))
    g = rows.groupBy(*keys, "i", "j").agg(F.sum(F.col("w") * F.col("p") * F.col("q")).alias("s"), F.sum(F.col("w") * F.col("p")).alias("sp"), F.sum(F.col("w") * F.col("q")).alias("sq"), F.sum("w").alias("n"))
    return g.select(*keys, "i", "j", (F.col("s") - (F.col("sp") * F.col("sq") / F.col("n") if centre else F.lit(0.0))).alias("g"))


def linear_cka(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cka): |X'Y|^2 / (|X'X| |Y'Y|) of centred columns."""
    square = lambda a, b, name: gram(pairs, keys, a, b).groupBy(*keys).agg(F.sum(F.col("g") * F.col("g")).alias(name))
    xy, xx, yy = square("x", "y", "xy"), square("x", "x", "xx"), square("y", "y", "yy")
    if keys:
        rows = xy.join(xx, list(keys)).join(yy, list(keys))
    else:
        rows = xy.crossJoin(xx).crossJoin(yy)
    d = F.sqrt(F.col("xx") * F.col("yy"))
    return rows.select(*keys, F.when(d > 1e-12, F.col("xy") / d).otherwise(F.lit(0.0)).alias("cka"))


def _grams(pairs: DataFrame, keys: Sequence[str], centre: bool = True, weight: str | None = None) -> DataFrame:
    out = None
    for kind, a, b in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")):
        g = gram(pairs, keys, a, b, centre, weight).withColumn("kind", F.lit(kind))
        out = g if out is None else out.unionByName(g)
    return out


def solved(pairs: DataFrame, keys: Sequence[str], fn: Callable, schema: list[str], centre: bool = True, weight: str | None = None) -> DataFrame:
    """fn(X'Y, X'X, Y'Y) of each slice as columns."""
    keyed = pairs if keys else pairs.withColumn("__all", F.lit(0))
    by = list(keys) or ["__all"]
    names = [s.split()[0] for s in schema]

    def run(key, table):
        m = {}
        for kind in ("xy", "xx", "yy"):
            t = table.filter(pa.array(np.array(table.column("kind").to_pylist()) == kind))
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            m[kind] = np.zeros((i.max() + 1, j.max() + 1))
            m[kind][i, j] = t.column("g").to_numpy()
        out = fn(m["xy"], m["xx"], m["yy"])
        n = len(out[names[0]])
        return pa.table({c: pa.array([k.as_py()] * n, table.schema.field(c).type) for c, k in zip(by, key, strict=True)} | {c: pa.array(out[c]) for c in names})

    g = _grams(keyed, by, centre, weight)
    made = g.groupBy(*by).applyInArrow(run, ", ".join([*(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in by), *schema]))
    return made if keys else made.drop("__all")


def _entries(m: np.ndarray) -> dict[str, np.ndarray]:
    i, j = np.indices(m.shape)
    return {"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "value": m.ravel()}


MAP = ["i int", "j int", "value double"]


def procrustes_map(pairs: DataFrame, keys: Sequence[str] = (), centre: bool = True, weight: str | None = None) -> DataFrame:
    """(keys, i, j, value): the orthogonal map of x to y."""

    def run(xy, xx, yy):
        del xx, yy
        u, _, vt = np.linalg.svd(xy)
        return _entries(u @ vt)

    return solved(pairs, keys, run, MAP, centre, weight)


def procrustes_error(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, nuclear, rmse): the sum of X'Y's singular values, and what the best map leaves per row."""
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else pairs.agg(F.count(F.lit(1)).alias("n"))

    def run(xy, xx, yy):
        s = np.linalg.svd(xy, compute_uv=False).sum()
        return {"nuclear": [float(s)], "left": [float(max(0.0, np.trace(xx) + np.trace(yy) - 2 * s))]}

    made = solved(pairs, keys, run, ["nuclear double", "left double"])
    rows = made.join(n, list(keys)) if keys else made.crossJoin(n)
    return rows.select(*keys, "nuclear", F.sqrt(F.col("left") / F.col("n")).alias("rmse"))


def ridge_map(pairs: DataFrame, keys: Sequence[str] = (), l2: float = 1e-3, weight: str | None = None) -> DataFrame:
    """(keys, i, j, value): (X'X + l2 I)^-1 X'Y."""

    def run(xy, xx, yy):
        del yy
        return _entries(np.linalg.solve(xx + l2 * np.eye(len(xx)), xy))

    return solved(pairs, keys, run, MAP, False, weight)


def canonical_correlations(pairs: DataFrame, keys: Sequence[str] = (), n: int = 8, reg: float = 1e-3) -> DataFrame:
    """(keys, k, rho): regularised canonical correlations, largest first."""

    def run(xy, xx, yy):
        a = K.inverse_root(xx + reg * np.trace(xx) / len(xx) * np.eye(len(xx)))
        b = K.inverse_root(yy + reg * np.trace(yy) / len(yy) * np.eye(len(yy)))
        s = np.linalg.svd(a @ xy @ b, compute_uv=False)[:n]
        return {"k": np.arange(len(s), dtype=np.int32), "rho": s}

    return solved(pairs, keys, run, ["k int", "rho double"])


def cycle_maps(pairs: DataFrame, keys: Sequence[str] = (), rounds: int = 200, rate: float = 0.05, l2: float = 1e-3, cycle: float = 0.5) -> DataFrame:
    """(keys, loss_xy, loss_yx, loss_cycle): two linear maps fitted together, each way and back again, by
    gradient steps on the Gram matrices alone."""

    def run(xy, xx, yy):
        scale = max(np.linalg.norm(xx, 2), np.linalg.norm(yy, 2), 1e-12)
        xy, xx, yy = xy / scale, xx / scale, yy / scale
        a, b = np.zeros(xy.shape), np.zeros(xy.T.shape)
        i, j = np.eye(len(xx)), np.eye(len(yy))
        for _ in range(rounds):
            ra, rb = a @ b - i, b @ a - j
            ga = xx @ a - xy + l2 * a + cycle * (xx @ ra @ b.T + b.T @ yy @ rb)
            gb = yy @ b - xy.T + l2 * b + cycle * (a.T @ xx @ ra + yy @ rb @ a.T)
            a, b = a - rate * ga, b - rate * gb
        part = lambda m, g, k, t: float(np.trace(t) - 2 * np.trace(m.T @ k) + np.trace(m.T @ g @ m))
        return {"loss_xy": [part(a, xx, xy, yy)], "loss_yx": [part(b, yy, xy.T, xx)], "loss_cycle": [float(np.trace((a @ b - i).T @ xx @ (a @ b - i)))]}

    return solved(pairs, keys, run, ["loss_xy double", "loss_yx double", "loss_cycle double"])


def row_cosine(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    c = X.cosine("x", "y")
    return pairs.groupBy(*keys).agg(F.avg(c).alias("mean_cosine"), F.count(F.lit(1)).alias("n"))


def top1_retrieval(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, top1): share of rows i of (i, j, score) whose best j, ties to the least, is i."""
    best = scores.groupBy(*keys, "i").agg(F.max_by("j", F.struct("score", -F.col("j"))).alias("b"))
    return best.groupBy(*keys).agg(F.avg((F.col("b") == F.col("i")).cast("double")).alias("top1"), F.count(F.lit(1)).alias("n"))


def cycle_return(ab: DataFrame, bc: DataFrame, ca: DataFrame) -> DataFrame:
    """(rate): share of starts that come back over the best match of each of three score tables."""
    best = lambda t, a, b: t.groupBy(F.col("i").alias(a)).agg(F.max_by("j", F.struct("score", -F.col("j"))).alias(b))
    rows = best(ab, "a", "b").join(best(bc, "b", "c"), "b").join(best(ca, "c", "back"), "c")
    return rows.agg(F.avg((F.col("back") == F.col("a")).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def smallest_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(overlap): share of the k pairs of least value in a that are so in b."""
    low = lambda t: t.orderBy("value", "u", "v").limit(k).select("u", "v")
    return low(a).join(low(b), ["u", "v"]).agg((F.count(F.lit(1)) / k).alias("overlap"))


def transport(cost: DataFrame, keys: Sequence[str], epsilon: float = 0.1) -> DataFrame:
    """(keys, cost, monotone, matched_cost): of a cost table (i, j, cost) with uniform marginals: cost of the
    entropic plan, rank correlation of i with its mean j, and cost of the best one-to-one matching."""

    def run(key, table):
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        m = np.zeros((i.max() + 1, j.max() + 1))
        m[i, j] = table.column("cost").to_numpy()
        plan = K.sinkhorn(m, epsilon * max(np.ptp(m), 1e-9))
        mapped = (plan @ np.arange(m.shape[1])) / np.maximum(plan.sum(1), 1e-12)
        rank = lambda x: np.argsort(np.argsort(x, kind="stable"), kind="stable")
        rho = np.corrcoef(np.arange(len(mapped)), rank(mapped))[0, 1] if len(mapped) > 2 else 0.0
        square = m if m.shape[0] <= m.shape[1] else m.T
        best = square[np.arange(len(square)), K.assignment(square)].mean()
        return pa.table({c: pa.array([v.as_py()], table.schema.field(c).type) for c, v in zip(keys, key, strict=True)} | {"cost": [float((plan * m).sum())], "monotone": [float(rho)], "matched_cost": [float(best)]})

    schema = ", ".join([*(f"{c} {cost.schema[c].dataType.simpleString()}" for c in keys), "cost double", "monotone double", "matched_cost double"])
    return cost.groupBy(*keys).applyInArrow(run, schema)


def gromov(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, loss, diagonal): Gromov-Wasserstein between the clouds x and y of paired points."""

    def run(key, table):
        table = table.sort_by("id")
        x, y = (np.array(table.column(c).to_pylist()) for c in ("x", "y"))
        cx, cy = K.pairwise(x), K.pairwise(y)
        plan, loss = K.gromov_wasserstein(cx / max(cx.max(), 1e-12), cy / max(cy.max(), 1e-12))
        return pa.table({c: pa.array([v.as_py()], table.schema.field(c).type) for c, v in zip(keys, key, strict=True)} | {"loss": [loss], "diagonal": [float(np.trace(plan))]})

    schema = ", ".join([*(f"{c} {points.schema[c].dataType.simpleString()}" for c in keys), "loss double", "diagonal double"])
    return points.groupBy(*keys).applyInArrow(run, schema)


def chart_maps(pairs: DataFrame, chart: str, least: int = 8) -> DataFrame:
    """(chart, i, j, value): an orthogonal map for each chart of at least `least` pairs, and under chart null
    the map of all pairs, which stands in for the others."""
    n = pairs.groupBy(chart).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(chart)
    own = procrustes_map(pairs.join(n, chart), [chart])
    return own.unionByName(procrustes_map(pairs).select(F.lit(None).cast(pairs.schema[chart].dataType).alias(chart), "i", "j", "value"))


def apply_maps(points: DataFrame, maps: DataFrame, chart: str, id_col: str = "id") -> DataFrame:
    """(id, chart, vec): vectors times their chart's map, or the common one. Maps are d * d numbers a chart."""
    has = maps.where(F.col(chart).isNotNull()).select(F.col(chart).alias("__has")).distinct()
    long = points.join(has, F.col(chart) == F.col("__has"), "left").select(F.col(id_col).alias("id"), F.col(chart).alias("own"), F.col("__has").alias("use"), F.posexplode("vec").alias("i", "x"))
    m = F.broadcast(maps.select(F.col(chart).alias("use_map"), F.col("i").alias("mi"), "j", "value"))
    out = long.join(m, F.col("use").eqNullSafe(F.col("use_map")) & (F.col("i") == F.col("mi"))).groupBy("id", "own", "j").agg(F.sum(F.col("x") * F.col("value")).alias("y"))
    return out.groupBy("id", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "y"))), lambda s: s["y"]).alias("vec")).withColumnRenamed("own", chart)


def cycle_residual(maps: dict[tuple, np.ndarray], charts: Sequence) -> float:
    """Mean over ordered triples of charts of how far the product of their three maps is from standing still."""
    gaps = [np.linalg.norm(maps[c, a] @ maps[b, c] @ maps[a, b] - np.eye(len(maps[a, b]))) / len(maps[a, b]) for a in charts for b in charts for c in charts if len({a, b, c}) == 3]
    return float(np.mean(gaps)) if gaps else 0.0


def codebook(points: DataFrame, n_tokens: int, seed: int = 7, id_col: str = "vec_id") -> DataFrame:
    """(id, token): k-means cells, with k at most one for 25 points and at least 4."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    k = min(n_tokens, max(4, n // 25))
    df = points.select(F.col(id_col).alias("id"), array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(df).transform(df).select("id", F.col("prediction").alias("token"))


def token_affinity(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b, n, n_positive) of the token pairs of labelled edges (u, v, y)."""
    rows = edges.join(tokens.select(F.col("id").alias("u"), F.col("token").alias("a")), "u").join(tokens.select(F.col("id").alias("v"), F.col("token").alias("b")), "v")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive"))


def descriptor_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(similarity) of two tables (name, value): exp of minus the mean square of scaled differences, the scale
    being the median absolute value."""
    rows = a.select("name", F.col("value").alias("x")).join(b.select("name", F.col("value").alias("y")), "name")
    scale = rows.select(F.explode(F.array(F.abs("x"), F.abs("y"))).alias("m")).agg(F.greatest(F.percentile("m", F.lit(0.5)), F.lit(1e-9)).alias("s"))
    return rows.crossJoin(F.broadcast(scale)).agg(F.exp(-F.avg(F.pow((F.col("x") - F.col("y")) / F.col("s"), 2))).alias("similarity"))


def perturbations(modules: DataFrame, n_each: int, salt: str = "perturb") -> DataFrame:
    """(spec, kind, a, b): n_each dropouts, sign flips and swaps of modules, drawn by hash."""
    m = modules.select("module").distinct()
    drawn = R.sample(m, n_each, "module", salt + ":drop").select(F.lit("dropout").alias("kind"), F.col("module").alias("a"), F.lit(None).cast(m.schema["module"].dataType).alias("b"))
    flips = R.sample(m, n_each, "module", salt + ":flip").select(F.lit("flip").alias("kind"), F.col("module").alias("a"), F.lit(None).cast(m.schema["module"].dataType).alias("b"))
    pairs = m.select(F.col("module").alias("a")).join(m.select(F.col("module").alias("b")), F.col("a") < F.col("b"))
    swaps = R.sample(pairs.withColumn("ab", F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))), n_each, "ab", salt + ":swap").select(F.lit("swap").alias("kind"), "a", "b")
    return drawn.unionByName(flips).unionByName(swaps).withColumn("spec", F.concat_ws(":", "kind", F.col("a").cast("string"), F.col("b").cast("string")))


def perturbed(vectors: DataFrame, specs: DataFrame, strengths: Sequence[float]) -> DataFrame:
    """(spec, strength, module, vec): module vectors (module, vec) under each perturbation at each strength:
    faded, turned towards its negative, or towards its partner's."""
    grid = specs.withColumn("strength", F.explode(F.array(*[F.lit(float(s)) for s in strengths])))
    rows = vectors.crossJoin(F.broadcast(grid))
    partner = vectors.select(F.col("module").alias("__p"), F.col("vec").alias("other"))
    to = F.when((F.col("kind") == "swap") & (F.col("module") == F.col("a")), F.col("b")).when((F.col("kind") == "swap") & (F.col("module") == F.col("b")), F.col("a"))
    rows = rows.withColumn("__to", to).join(partner, F.col("__to") == F.col("__p"), "left")
    s, hit = F.col("strength"), F.col("module") == F.col("a")
    vec = (
        F.when(F.col("__to").isNotNull(), F.zip_with("vec", "other", lambda x, y: (1 - s) * x + s * y))
        .when(hit & (F.col("kind") == "dropout"), F.transform("vec", lambda x: (1 - s) * x))
        .when(hit & (F.col("kind") == "flip"), F.transform("vec", lambda x: (1 - 2 * s) * x))
        .otherwise(F.col("vec"))
    )
    return rows.select("spec", "strength", "module", vec.alias("vec"))


def transition_matrix(vectors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, p): cosines of module vectors, ranked over all pairs, as shares of their row."""
    a = vectors.select(*keys, F.col("module").alias("i"), F.col("vec").alias("x"))
    b = vectors.select(*keys, F.col("module").alias("j"), F.col("vec").alias("y"))
    c = (a.join(b, list(keys)) if keys else a.crossJoin(b)).select(*keys, "i", "j", X.cosine("x", "y").alias("c")).withColumn("r", rank_share("c", keys))
    return c.select(*keys, "i", "j", (F.col("r") / F.sum("r").over(Window.partitionBy(*keys, "i"))).alias("p"))


def response(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, response): mean absolute change of a transition matrix (i, j, p)."""
    rows = after.join(before.select("i", "j", F.col("p").alias("p0")), ["i", "j"])
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col("p") - F.col("p0"))).alias("response"))


def depth_warp(layers: DataFrame, target: DataFrame, warps: Sequence[Sequence[float]]) -> DataFrame:
    """(warp, cost): for each weighting of the layers the cost of the best matching of the blended module
    vectors (layer, module, vec) to the target's (module, vec)."""
    out = None
    for n, weights in enumerate(warps):
        w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("layer") + 1).cast("int"))
        long = layers.withColumn("w", w).select("module", "w", F.posexplode("vec").alias("d", "x"))
        blended = long.groupBy("module", "d").agg(F.sum(F.col("w") * F.col("x")).alias("x")).groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("x"))
        pair = blended.select(F.col("module").alias("a"), "x").crossJoin(target.select(F.col("module").alias("b"), F.col("vec").alias("y")))
        c = pair.select(F.lit(n).alias("warp"), (F.dense_rank().over(Window.partitionBy(F.lit(n)).orderBy("a")) - 1).alias("i"), (F.dense_rank().over(Window.partitionBy(F.lit(n)).orderBy("b")) - 1).alias("j"), X.distance("x", "y").alias("cost"))
        out = c if out is None else out.unionByName(c)
    return transport(out, ["warp"]).select("warp", F.col("matched_cost").alias("cost"))
