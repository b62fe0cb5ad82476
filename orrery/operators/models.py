"""Scores and models of an edge table: cross-validated logistic regression, linear fits, differences of
AUC, and null families over them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import auc, quantile
from . import kernels as K
from .vectors import _matrix


def cv_logistic(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], baseline: str | None = None, l1: float = 0.0, l2: float = 1e-3) -> DataFrame:
    """(keys, n, n_positive, auc_base, auc_model, delta): AUC of a baseline column and of out-of-fold logistic
    scores over a column `fold`. A slice, or a replicate of one, is a group; its rows are capped by whoever
    samples the edges. Null where a class is missing."""
    cols = [*keys, label, "fold", *features, *([baseline] if baseline and baseline not in features else [])]

    def run(key, table):
        y = table.column(label).to_numpy()
        x = np.column_stack([table.column(c).to_numpy() for c in features]).astype(float)
        model = K.cv_auc(x, y, table.column("fold").to_numpy(), l1, l2)
        base = K.auc(y, table.column(baseline).to_numpy()) if baseline else None
        delta = None if model is None or base is None else model - base
        values = {"n": [len(y)], "n_positive": [int((y > 0).sum())], "auc_base": pa.array([base], pa.float64()), "auc_model": pa.array([model], pa.float64()), "delta": pa.array([delta], pa.float64())}
        return pa.table({c: pa.array([v.as_py()], table.schema.field(c).type) for c, v in zip(keys, key, strict=True)} | values)

    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), "n long", "n_positive long", "auc_base double", "auc_model double", "delta double"])
    return df.select(*dict.fromkeys(cols)).groupBy(*keys).applyInArrow(run, schema)


def coefficients(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], l1: float = 0.01) -> DataFrame:
    """(keys, feature, coefficient, nonzero) of an L1 logistic fit of each slice."""

    def run(key, table):
        y = (table.column(label).to_numpy() > 0).astype(float)
        x = np.column_stack([table.column(c).to_numpy() for c in features]).astype(float)
        c = K.logistic(np.nan_to_num(x), y, l1) if 0 < y.sum() < len(y) else np.zeros(len(features) + 1)
        n = len(features)
        return pa.table({k: pa.array([v.as_py()] * n, table.schema.field(k).type) for k, v in zip(keys, key, strict=True)} | {"feature": list(features), "coefficient": c[:-1], "nonzero": np.abs(c[:-1]) > 1e-8})

    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), "feature string", "coefficient double", "nonzero boolean"])
    return df.select(*keys, label, *features).groupBy(*keys).applyInArrow(run, schema)


def selection_frequency(selected: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, frequency, sign_agreement, stable) over replicates of coefficients()."""
    sign = F.signum("coefficient")
    hit = F.col("nonzero").cast("int")
    g = selected.groupBy(*keys, "feature").agg(F.avg(hit).alias("frequency"), (F.abs(F.sum(sign * hit)) / F.greatest(F.sum(hit), F.lit(1))).alias("sign_agreement"))
    return g.withColumn("stable", (F.col("frequency") >= 0.6) & (F.col("sign_agreement") >= 0.8))


def leave_group_out_r2(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(group, n, r2): each group predicted by the line through all other groups, from totals less its own."""
    a, b = F.col(x), F.col(y)
    s = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))
    w = Window.partitionBy()
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy")}
    t = s.select(group, "n", "sx", "sy", "sxx", "sxy", "syy", *[e.alias(f"r_{c}") for c, e in rest.items()])
    d = F.col("r_n") * F.col("r_sxx") - F.col("r_sx") * F.col("r_sx")
    slope = F.when(F.abs(d) > 1e-12, (F.col("r_n") * F.col("r_sxy") - F.col("r_sx") * F.col("r_sy")) / d).otherwise(F.lit(0.0))
    t = t.withColumn("m", slope).withColumn("c", (F.col("r_sy") - F.col("m") * F.col("r_sx")) / F.col("r_n"))
    sse = F.col("syy") - 2 * F.col("m") * F.col("sxy") - 2 * F.col("c") * F.col("sy") + F.col("m") * F.col("m") * F.col("sxx") + 2 * F.col("m") * F.col("c") * F.col("sx") + F.col("n") * F.col("c") * F.col("c")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return t.select(group, "n", F.when(sst > 1e-12, 1 - sse / sst).otherwise(F.lit(0.0)).alias("r2"))


def robust_r2(df: DataFrame, y: str, predicted: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(r2, winsorized_r2, trimmed_r2): clipped to, and left out beyond, y's quantiles."""
    cut = df.agg(quantile(y, [low, high]).alias("q"))
    rows = df.crossJoin(F.broadcast(cut)).select(F.col(y).alias("y"), F.col(predicted).alias("p"), F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    clip = lambda c: F.least(F.greatest(c, F.col("a")), F.col("b"))
    rows = rows.withColumn("cy", clip(F.col("y"))).withColumn("cp", clip(F.col("p"))).withColumn("inside", F.col("y").between(F.col("a"), F.col("b")))

    def r2(y_, p_):
        sst = F.var_pop(y_) * F.count(y_)
        return F.when(sst > 1e-12, 1 - F.sum((y_ - p_) * (y_ - p_)) / sst).otherwise(F.lit(0.0))

    inner = lambda c: F.when(F.col("inside"), F.col(c))
    return rows.agg(r2(F.col("y"), F.col("p")).alias("r2"), r2(F.col("cy"), F.col("cp")).alias("winsorized_r2"), r2(inner("y"), inner("p")).alias("trimmed_r2"))


def best_breakpoint(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, breakpoint, sse, sse_line): the inner x at which two lines, both with the point, fit best."""
    points = df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    lo = points.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cuts = points.select(*keys, F.col("x").alias("cut")).distinct()
    cuts = (cuts.join(lo, list(keys)) if keys else cuts.crossJoin(lo)).where("cut > lo and cut < hi").select(*keys, "cut")
    rows = points.join(cuts, list(keys)) if keys else points.crossJoin(cuts)

    def sse(cond):
        a, b = F.when(cond, F.col("x")), F.when(cond, F.col("y"))
        return F.coalesce(F.regr_syy(b, a) - F.when(F.regr_sxx(b, a) > 1e-12, F.pow(F.regr_sxy(b, a), 2) / F.regr_sxx(b, a)).otherwise(F.lit(0.0)), F.lit(0.0))

    g = rows.groupBy(*keys, "cut").agg((sse(F.col("x") <= F.col("cut")) + sse(F.col("x") >= F.col("cut"))).alias("sse"), sse(F.lit(True)).alias("line"))
    best = F.min_by(F.struct("cut", "sse", "line"), F.struct("sse", "cut"))
    return g.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.cut").alias("breakpoint"), F.col("b.sse").alias("sse"), F.col("b.line").alias("sse_line"))


def subset_delta_auc(df: DataFrame, label: str, base: str, other: str, keys: Sequence[str] = (), least: int = 40) -> DataFrame:
    """(keys, delta_auc): AUC of other less that of base; null in a slice of fewer than `least` rows."""
    a = auc(df, label, base, keys, "a").select(*keys, "a", (F.col("n_positive") + F.col("n_negative")).alias("n"))
    b = auc(df, label, other, keys, "b").select(*keys, "b")
    rows = a.join(b, list(keys)) if keys else a.crossJoin(b)
    return rows.select(*keys, "n", F.when(F.col("n") >= least, F.col("b") - F.col("a")).alias("delta_auc"))


def _generator(keys: Sequence[str], key, draw: str | None, *seed: int) -> np.random.Generator:
    """Of the seed, and of the value of the key column `draw` if there is one."""
    return np.random.default_rng([*seed, *([int(key[list(keys).index(draw)].as_py())] if draw else [])])


def rewired(edges: DataFrame, keys: Sequence[str], swaps_per_edge: int = 4, replicate: int = 0, draw: str | None = None) -> DataFrame:
    """(keys, u, v): each slice's undirected edges after double-edge swaps that keep every degree. Slices of
    another value of the key column `draw` are swapped in another way."""

    def run(key, table):
        e = np.column_stack([table.column("u").to_numpy(), table.column("v").to_numpy()])
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        rng = _generator(keys, key, draw, 7919 + replicate)
        out = K.double_edge_swaps(e, 0, rng.random((swaps_per_edge * len(e), 3)))
        n = len(out)
        return pa.table({c: pa.array([v.as_py()] * n, table.schema.field(c).type) for c, v in zip(keys, key, strict=True)} | {"u": out.min(1), "v": out.max(1)})

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in [*keys, "u", "v"])
    return edges.select(*keys, "u", "v").groupBy(*keys).applyInArrow(run, kinds)


def linear_predict(train: DataFrame, test: DataFrame, features: Sequence[str], y: str, out: str = "predicted") -> DataFrame:
    """test with least-squares predictions learnt from train; null where train has fewer than 3 rows. The
    sums of products are one aggregate; only they, (features + 1) squared numbers, are solved in one task."""
    names = ["__1", *features]
    t = train.select(F.lit(1.0).alias("__1"), *[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias("__y")).na.drop()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = t.agg(F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs], *[F.sum(F.col(a) * F.col("__y")) for a in names]).alias("s"), F.count(F.lit(1)).alias("n"))

    def solve(batches):
        for b in batches:
            found = []
            for s, n in zip(b.column("s").to_pylist(), b.column("n").to_pylist(), strict=True):
                if n < 3:
                    found.append(None)
                    continue
                m, k = np.zeros((len(names), len(names))), len(pairs)
                for (x, z), v in zip(pairs, s[:k], strict=True):
                    m[names.index(x), names.index(z)] = m[names.index(z), names.index(x)] = v
                found.append(np.linalg.lstsq(m, np.array(s[k:]), rcond=None)[0].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], ["__w"])

    w = sums.mapInArrow(solve, "__w array<double>")
    total = F.col("__w")[0]
    for i, f in enumerate(features):
        total = total + F.col("__w")[i + 1] * F.col(f)
    return test.crossJoin(F.broadcast(w)).withColumn(out, total).drop("__w")  # one row


def rewired_in_strata(edges: DataFrame, strata: DataFrame, keys: Sequence[str], swaps_per_edge: int = 4, replicate: int = 0, draw: str | None = None) -> DataFrame:
    """(keys, u, v): double-edge swaps that keep every degree and the number of edges of each stratum;
    strata: (keys, u, v, stratum) of all pairs u < v that may be an edge, unlisted ones are stratum -1."""

    def run(key, left, right):
        e = np.column_stack([left.column("u").to_numpy(), left.column("v").to_numpy()])
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        of = {(a, b): s for a, b, s in zip(*(right.column(c).to_pylist() for c in ("u", "v", "stratum")), strict=True)}
        draws = _generator(keys, key, draw, 7919 + replicate).random((swaps_per_edge * len(e), 3))
        out = K.double_edge_swaps(e, 0, draws, lambda a, b: of.get((min(a, b), max(a, b)), -1))
        n = len(out)
        return pa.table({c: pa.array([v.as_py()] * n, left.schema.field(c).type) for c, v in zip(keys, key, strict=True)} | {"u": out.min(1) if n else e[:0, 0], "v": out.max(1) if n else e[:0, 0]})

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in [*keys, "u", "v"])
    right = strata.select(*keys, "u", "v", "stratum")
    return edges.select(*keys, "u", "v").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kinds)


def rewired_to_lengths(edges: DataFrame, points: DataFrame, keys: Sequence[str], bins: int = 8, trials: int = 6, good: float = 0.1, swaps_per_edge: int = 4, replicate: int = 0, id_col: str = "vec_id", draw: str | None = None) -> DataFrame:
    """(keys, u, v): of some rewired graphs that keep every degree and hang together, the one whose edge
    lengths, in quantile bins of those before, are spread most like them; the first within `good`, as a
    share of the edges. A slice none of whose trials hangs together keeps its edges."""

    def run(key, left, right):
        right = right.sort_by("id")
        ids, p = right.column("id").to_numpy(), _matrix(right)
        e = np.column_stack([left.column("u").to_numpy(), left.column("v").to_numpy()])
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        far = lambda x: np.linalg.norm(p[np.searchsorted(ids, x[:, 0])] - p[np.searchsorted(ids, x[:, 1])], axis=1)
        cuts = np.quantile(far(e), np.linspace(0, 1, bins + 1)[1:-1]) if len(e) else np.empty(0)
        spread = lambda x: np.bincount(np.searchsorted(cuts, far(x)), minlength=bins)
        best, best_gap = e, np.inf
        for t in range(trials if len(e) > 1 else 0):
            out = K.double_edge_swaps(e, 0, _generator(keys, key, draw, 7919, replicate, t).random((swaps_per_edge * len(e), 3)))
            if K.parts(out) > max(1, K.parts(e)):
                continue
            gap = np.abs(spread(out) - spread(e)).sum() / len(e)
            if gap < best_gap:
                best, best_gap = out, gap
            if gap <= good:
                break
        n = len(best)
        return pa.table({c: pa.array([v.as_py()] * n, left.schema.field(c).type) for c, v in zip(keys, key, strict=True)} | {"u": best.min(1) if n else e[:0, 0], "v": best.max(1) if n else e[:0, 0]})

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in [*keys, "u", "v"])
    cloud = points.select(*keys, F.col(id_col).alias("id"), "vec")
    return edges.select(*keys, "u", "v").groupBy(*keys).cogroup(cloud.groupBy(*keys)).applyInArrow(run, kinds)


def drawn_by_degree(edges: DataFrame, keys: Sequence[str], replicate: int = 0, value: str = "distance") -> DataFrame:
    """(keys, u, v, value): as many random edges as a slice has, ends drawn in proportion to their degrees,
    and its values dealt to them in random order. Where draws repeat too often, the first pairs by id fill up."""

    def run(key, table):
        u, v, x = (table.column(c).to_numpy() for c in ("u", "v", value))
        ids, degree = np.unique(np.concatenate([u, v]), return_counts=True)
        rng = np.random.default_rng([104729, replicate])
        share = degree / degree.sum()
        found: set[tuple] = set()
        for a, b in zip(*(rng.choice(len(ids), 40 * len(u), p=share).tolist() for _ in range(2)), strict=True):
            if len(found) == len(u):
                break
            if a != b:
                found.add((min(a, b), max(a, b)))
        if len(found) < max(4, len(u) // 2):
            rest = ((a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if (a, b) not in found)
            found.update(itertools.islice(rest, len(u) - len(found)))
        e = np.array(sorted(found), np.int64).reshape(-1, 2)
        n = len(e)
        return pa.table({c: pa.array([k.as_py()] * n, table.schema.field(c).type) for c, k in zip(keys, key, strict=True)} | {"u": ids[e[:, 0]], "v": ids[e[:, 1]], value: rng.permutation(x)[:n]})

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in [*keys, "u", "v", value])
    return edges.select(*keys, "u", "v", value).groupBy(*keys).applyInArrow(run, kinds)
