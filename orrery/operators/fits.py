"""Logistic models of many keys fitted together: one pass over the rows a round, whatever the number of models.

A model is a key and a fold; it learns from the rows of the key's other folds. A round adds up, inside Arrow
batches, each model's loss, gradient and Hessian at its coefficients; the sums of a model meet in one task, a
few hundred numbers each, and give the next coefficients: a proximal Newton step, halved where it went uphill.
Models that stand still leave, and so do their rows' passes. A key with very many rows lies in many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import auc
from .graph import written

#: Rows of a key that one task takes at most, where adaptive execution is off and doesn't split what is large.
PART = 100_000
#: Keys whose coefficients are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 20_000
#: Keys whose sums one task adds up.
TASK_KEYS = 200


def _doubles(column) -> np.ndarray:
    """A column of lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _rows(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a, float).reshape(len(a), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))


def _starts(ids: np.ndarray) -> np.ndarray:
    return np.nonzero(np.r_[True, ids[1:] != ids[:-1]])[0]


def _prepare(features: Sequence[str]):
    """Of each run of a key's rows in a batch, by fold: rows, positive ones, means, and squares about the means."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kid, fold, y = (b[c].to_numpy(zero_copy_only=False) for c in ("__kid", "__fold", "__y"))
            x = np.column_stack([b[f].to_numpy(zero_copy_only=False) for f in features])
            order = np.lexsort((fold, kid))
            kid, fold, y, x = kid[order], fold[order], y[order], x[order]
            at = np.nonzero(np.r_[True, (kid[1:] != kid[:-1]) | (fold[1:] != fold[:-1])])[0]
            n = np.diff(np.r_[at, len(kid)])
            mean = np.add.reduceat(x, at) / n[:, None]
            apart = x - np.repeat(mean, n, axis=0)
            sums = np.c_[n, np.add.reduceat(y, at), mean, np.add.reduceat(apart * apart, at)]
            yield pa.RecordBatch.from_arrays([pa.array(kid[at]), pa.array(fold[at]), _rows(sums)], ["__kid", "__fold", "__s"])

    return run


def _merged(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Counts, means and squares of two disjoint sets of rows as those of both."""
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[2 : 2 + p] - a[2 : 2 + p]
    return np.r_[n, a[1] + b[1], a[2 : 2 + p] + gap * (b[0] / n), a[2 + p :] + b[2 + p :] + gap * gap * (a[0] * b[0] / n)]


def _begin(p: int, folds: int):
    """Scales and coefficients of each key's models: by fold n, the share of positives, means and deviations of
    the rows it learns from. State: b, b before, objective before, step share, whether it is done."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, f, s in zip(batch["__kid"].to_pylist(), batch["__fold"].to_pylist(), _doubles(batch["__s"]), strict=True):
                own = held.setdefault(k, np.zeros((folds, 2 + 2 * p)))
                own[f] = _merged(own[f], s, p)
        if not held:
            return
        scale, state = [], []
        for own in held.values():
            for f in range(folds):
                rest = np.zeros(2 + 2 * p)
                for g in range(folds):
                    if g != f or folds == 1:
                        rest = _merged(rest, own[g], p)
                n = max(rest[0], 1.0)
                scale.append(np.r_[rest[0], rest[1] / n, rest[2 : 2 + p], np.maximum(np.sqrt(np.maximum(rest[2 + p :], 0) / n), 1e-8)])
                fits = 0 < rest[1] < rest[0] and own[f][0] > 0 or folds == 1 and 0 < rest[1] < rest[0]
                state.append(np.r_[np.zeros(2 * p + 2), np.inf, 1.0, 0.0 if fits else 2.0])
        k = len(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), _rows(np.reshape(scale, (k, -1))), _rows(np.reshape(state, (k, -1)))], ["__kid", "__scale", "__state"])

    return run


def _pass(features: Sequence[str], folds: int, balanced: bool):
    """Of each run of a key's rows in a batch, by fold: weighted loss, gradient and Hessian at the model's coefficients."""
    p = len(features)
    i, j = np.triu_indices(p + 1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kid, fold, y = (b[c].to_numpy(zero_copy_only=False) for c in ("__kid", "__fold", "__y"))
            order = np.argsort(kid, kind="stable")
            kid, fold, y = kid[order], fold[order], y[order]
            x = np.column_stack([b[f].to_numpy(zero_copy_only=False) for f in features])[order]
            at = _starts(kid)
            n = np.diff(np.r_[at, len(kid)])
            first = order[at]
            scale = _doubles(b["__scale"].take(pa.array(first))).reshape(len(at), folds, -1)
            state = _doubles(b["__state"].take(pa.array(first))).reshape(len(at), folds, -1)
            out = []
            for f in range(folds):
                s, c = (np.repeat(v[:, f], n, axis=0) for v in (scale, state))
                a = np.c_[(x - s[:, 2 : 2 + p]) / s[:, 2 + p :], np.ones(len(x))]
                z = np.clip((a * c[:, : p + 1]).sum(1), -500, 500)
                rate = s[:, 1]
                w = np.where(y > 0, 0.5 / np.maximum(rate, 1e-9), 0.5 / np.maximum(1 - rate, 1e-9)) if balanced else np.ones(len(y))
                w = np.where((fold != f) | (folds == 1), w, 0.0)
                q = 1 / (1 + np.exp(-z))
                loss = w * (np.logaddexp(0, z) - y * z)
                grad = a * (w * (q - y))[:, None]
                hess = a[:, i] * a[:, j] * (w * q * (1 - q))[:, None]
                out.append(np.add.reduceat(np.c_[loss, grad, hess], at))
            yield pa.RecordBatch.from_arrays([pa.array(kid[at]), _rows(np.stack(out, 1))], ["__kid", "__s"])

    return run


def quadratic(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: float, l2: float, sweeps: int = 400) -> np.ndarray:
    """The minima of g·(c - b) + (c - b)'h(c - b)/2 + l1 |c| + l2 |c|²/2, c's last part unpenalised, of many models
    at once by descent along each part in turn."""
    c, r = b.copy(), g.copy()  # r: the gradient of the smooth part without l2
    p = b.shape[1]
    curve = np.maximum(h[:, np.arange(p), np.arange(p)], 1e-10)
    for _ in range(sweeps):
        most = 0.0
        for k in range(p):
            if k == p - 1:
                new = c[:, k] - r[:, k] / curve[:, k]
            else:
                raw = curve[:, k] * c[:, k] - r[:, k]
                new = np.sign(raw) * np.maximum(np.abs(raw) - l1, 0) / (curve[:, k] + l2)
            d = new - c[:, k]
            if (far := np.abs(d).max(initial=0)) > 0:
                r += h[:, :, k] * d[:, None]
                c[:, k] = new
                most = max(most, far)
        if most < 1e-11:
            break
    return c


def _step(p: int, folds: int, l1: float, l2: float, still: float):
    """The next coefficients of the keys of a task, from their sums."""
    i, j = np.triu_indices(p + 1)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            s = b["__s"]
            for row, k in enumerate(b["__kid"].to_pylist()):
                if s[row].is_valid:
                    v = s[row].values.to_numpy()
                    sums[k] = sums[k] + v if k in sums else v
                else:
                    known[k] = b["__scale"][row].values.to_numpy(), b["__state"][row].values.to_numpy()
        ids = list(known)
        if not ids:
            return
        scale = np.array([known[k][0] for k in ids]).reshape(len(ids) * folds, -1)
        state = np.array([known[k][1] for k in ids]).reshape(len(ids) * folds, -1).copy()
        width = 1 + (p + 1) + len(i)
        s = np.array([sums.get(k, np.zeros(folds * width)) for k in ids]).reshape(len(ids) * folds, width)
        n = np.maximum(scale[:, :1], 1)
        b, before, best, share, done = state[:, : p + 1], state[:, p + 1 : 2 * p + 2], state[:, 2 * p + 2], state[:, 2 * p + 3], state[:, 2 * p + 4]
        value = s[:, 0] / n[:, 0] + l1 * np.abs(b[:, :-1]).sum(1) + l2 / 2 * (b[:, :-1] ** 2).sum(1)
        open_ = done == 0
        worse = open_ & (value > best + 1e-12 * np.abs(best)) & (share > 1e-6)
        go = open_ & ~worse
        # uphill: half the way back
        state[worse, 2 * p + 3] = share[worse] / 2
        state[worse, : p + 1] = (b[worse] + before[worse]) / 2
        if go.any():
            g = s[go, 1 : p + 2] / n[go]
            h = np.zeros((int(go.sum()), p + 1, p + 1))
            h[:, i, j] = s[go, p + 2 :] / n[go]
            h[:, j, i] = h[:, i, j]
            new = quadratic(g, h, b[go], l1, l2)
            moved = np.abs(new - b[go]).max(1)
            here = b[go].copy()
            state[go, p + 1 : 2 * p + 2] = here
            state[go, : p + 1] = new
            state[go, 2 * p + 2] = value[go]
            state[go, 2 * p + 3] = 1.0
            state[go, 2 * p + 4] = np.where(moved < still, 1.0, 0.0)
        k = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _rows(scale.reshape(k, -1)), _rows(state.reshape(k, -1))], ["__kid", "__scale", "__state"])

    return run


def _open(folds: int, p: int):
    width = 2 * p + 5
    return F.exists(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.element_at("__state", (f * width + width).cast("int")) == 0)


def fit(df: DataFrame | Sequence[DataFrame], features: Sequence[str], label: str, keys: Sequence[str], fold: str | None = None, folds: int = 1, l1: float = 0.0, l2: float = 0.0, balanced: bool = True, rounds: int = 40, still: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """(rows, models). df may be several tables, each planned and written by itself. rows: their keys, label, fold and features, with __kid, the number of the key. models: (__kid, keys,
    weights): the coefficients by fold, the intercept last, of an L1 and L2 penalised logistic regression (penalties per row, none
    on the intercept, columns standardised, classes balanced) learnt from the rows of the other folds, from all of them
    without folds; null where those, or the fold, lack a class or rows. Missing features are 0. Keys may not be null."""
    p = len(features)
    one = F.lit(0) if fold is None else F.col(fold)
    x = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"__x{i}") for i, f in enumerate(features)]
    names = [f"__x{i}" for i in range(p)]
    # each table is written once, dealt out by key; adaptive execution splits what is large
    raw = None
    for t in [df] if isinstance(df, DataFrame) else df:
        own = t.select(*keys, (F.col(label) > 0).cast("double").alias("__y"), one.cast("int").alias("__fold"), *x)
        own = written(own.hint("rebalance", *keys).sortWithinPartitions(*keys, "__fold") if keys else own, "fit-rows")
        raw = own if raw is None else raw.unionByName(own)
    sizes = written(raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).withColumn("__kid", F.monotonically_increasing_id()), "fit-keys")
    n_keys, most = sizes.agg(F.count(F.lit(1)), F.max("__rows")).first()
    split = raw.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    if n_keys <= BROADCAST_KEYS and (split or (most or 0) <= PART):
        kids = F.broadcast(sizes.drop("__rows"))
        rows = raw.join(kids, list(keys)) if keys else raw.crossJoin(kids)  # without keys one row
    else:
        part = F.pmod(F.xxhash64("__y", *names), F.ceil(F.col("__rows") / PART).cast("long"))
        joined = raw.join(sizes, list(keys)) if keys else raw.crossJoin(F.broadcast(sizes))
        rows = written(joined.withColumn("__part", part).repartition("__kid", "__part").sortWithinPartitions("__kid", "__fold").drop("__rows", "__part"), "fit-rows")
    tasks = max(1, -(-n_keys // TASK_KEYS))
    parts = rows.select("__kid", "__fold", "__y", *names).mapInArrow(_prepare(names), "__kid long, __fold int, __s array<double>")
    kind = "__kid long, __scale array<double>, __state array<double>"
    state = written(parts.repartition(tasks, "__kid").mapInArrow(_begin(p, folds), kind), "fit-state")
    closed = state.limit(0)
    for _ in range(rounds):
        going = state.where(_open(folds, p))
        n_open = going.count()
        if not n_open:
            break
        ahead = F.broadcast(going) if n_open <= BROADCAST_KEYS else going
        sums = rows.select("__kid", "__fold", "__y", *names).join(ahead, "__kid").mapInArrow(_pass(names, folds, balanced), "__kid long, __s array<double>")
        none = F.lit(None).cast("array<double>")
        both = sums.select("__kid", "__s", none.alias("__scale"), none.alias("__state")).unionByName(going.select("__kid", none.alias("__s"), "__scale", "__state"))
        closed = closed.unionByName(state.where(~_open(folds, p)))
        state = written(both.repartition(tasks, "__kid").mapInArrow(_step(p, folds, l1, l2, still), kind), "fit-state")
    every = closed.unionByName(state)
    width, per = 2 * p + 5, 2 + 2 * p

    def raw_weights(f):
        at, of = f * width, f * per
        w = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.element_at("__state", (at + i + 1).cast("int")) / F.element_at("__scale", (of + 2 + p + i + 1).cast("int")))
        shift = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.element_at("__state", (at + i + 1).cast("int")) / F.element_at("__scale", (of + 2 + p + i + 1).cast("int")) * F.element_at("__scale", (of + 2 + i + 1).cast("int"))), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.element_at("__state", (at + width).cast("int")) < 2, F.concat(w, F.array(F.element_at("__state", (at + p + 1).cast("int")) - shift)))

    weights = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), raw_weights)
    models = every.select("__kid", weights.alias("weights")).join(sizes.drop("__rows"), "__kid")
    return rows, written(models, "fit-models")


def cross_validated(df: DataFrame | Sequence[DataFrame], features: Sequence[str], label: str, keys: Sequence[str], baseline: str | None = None, l1: float = 0.0, l2: float = 1e-3, fold: str = "fold", folds: int = 3) -> DataFrame:
    """(keys, n, n_positive, auc_base, auc_model, delta) of out-of-fold scores, as models.cv_logistic gives them of one
    slice a task. Null where a class is missing in the key or in what a fold learns from."""
    rows, models = fit(df, features, label, keys, fold, folds, l1, l2)
    p = len(features)
    n_models = models.count()
    weights = models.select("__kid", "weights")
    scored = rows.join(F.broadcast(weights) if n_models <= BROADCAST_KEYS else weights, "__kid")
    own = F.element_at("weights", F.col("__fold") + 1)
    terms = [F.element_at(own, i + 1) * F.col(f"__x{i}") for i in range(p)]
    score = terms[0]
    for t in terms[1:]:
        score = score + t
    scored = scored.withColumn("__score", score + F.element_at(own, p + 1))
    model = auc(scored, "__y", "__score", list(keys), "auc_model").select(*keys, "auc_model")
    if baseline in features:
        base = auc(rows, "__y", f"__x{list(features).index(baseline)}", list(keys), "auc_base").select(*keys, "auc_base")
    else:
        every = df if isinstance(df, DataFrame) else reduce(DataFrame.unionByName, df)
        base = auc(every, label, baseline, list(keys), "auc_base").select(*keys, "auc_base") if baseline else None
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").cast("long").alias("n_positive"), F.collect_set("__fold").alias("__there"))
    state = models.select(*keys, "weights")
    lacking = F.exists("__there", lambda f: F.element_at("weights", f + 1).isNull())
    out = size.join(state, list(keys)).join(model, list(keys), "left")
    out = out.join(base, list(keys), "left") if baseline else out.withColumn("auc_base", F.lit(None).cast("double"))
    out = out.withColumn("auc_model", F.when(~lacking, F.col("auc_model")))
    return out.select(*keys, "n", "n_positive", "auc_base", "auc_model", (F.col("auc_model") - F.col("auc_base")).alias("delta"))
