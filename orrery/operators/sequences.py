"""Token sequences as rows (seq, pos, token): transitions, log-odds, run-length segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def transitions(tokens: DataFrame, seq: str = "user_id", order: int = 1) -> DataFrame:
    """(seq, pos, history..., token): each token with the `order` before it, h1 the nearest."""
    w = Window.partitionBy(seq).orderBy("pos")
    out = tokens
    for k in range(1, order + 1):
        out = out.withColumn(f"h{k}", F.lag("token", k).over(w))
    return out.where(F.col(f"h{order}").isNotNull())


def transition_entropy(tokens: DataFrame, seq: str = "user_id") -> DataFrame:
    """(seq, n, entropy) of the bigrams of each sequence, in nats."""
    c = transitions(tokens, seq).groupBy(seq, "h1", "token").agg(F.count(F.lit(1)).alias("n"))
    t = F.sum("n")
    return c.groupBy(seq).agg(t.alias("n"), (F.ln(t) - F.sum(F.col("n") * F.ln("n")) / t).alias("entropy"))


def log_odds(steps: DataFrame, history: Sequence[str], label: str, n_tokens: Column | int, alpha: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, history, token, log_odds): smoothed log probability of the token after its history among
    positives, less that among negatives. Histories seen in one class only are compared with a flat one."""
    pos = F.sum(F.when(F.col(label) > 0, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) > 0, 0).otherwise(1))
    c = steps.groupBy(*keys, *history, "token").agg(pos.alias("p"), neg.alias("q"))
    w = Window.partitionBy(*keys, *history)
    k = F.lit(n_tokens) if isinstance(n_tokens, int) else n_tokens
    lp = F.ln((F.col("p") + alpha) / (F.sum("p").over(w) + alpha * k))
    lq = F.ln((F.col("q") + alpha) / (F.sum("q").over(w) + alpha * k))
    return c.select(*keys, *history, "token", "p", "q", (lp - lq).alias("log_odds"))


def cross_fitted_scores(tokens: DataFrame, labels: DataFrame, orders: Sequence[int] = (1,), alpha: float = 1.0, seq: str = "user_id") -> DataFrame:
    """(seq, label, fold, score): summed log-odds of each sequence's steps, learnt on the other folds.
    labels: (seq, label, fold). Counts of a fold are totals less its own, so each step is counted once."""
    n = tokens.select(F.count_distinct("token").alias("k")).first()["k"]
    out = labels.withColumn("score", F.lit(0.0))
    for order in orders:
        h = [f"h{i}" for i in range(1, order + 1)] if order else []
        steps = (transitions(tokens, seq, order) if order else tokens.where("pos = 1")).join(labels, seq)
        hit = (F.col("label") > 0).cast("int")
        own = steps.groupBy("fold", *h, "token").agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("q"))
        every = own.groupBy(*h, "token").agg(F.sum("p").alias("tp"), F.sum("q").alias("tq"))
        folds = labels.select("fold").distinct()
        grid = every.crossJoin(F.broadcast(folds)).join(own, ["fold", *h, "token"], "left").na.fill(0, ["p", "q"])
        w = Window.partitionBy("fold", *h)
        a, b = F.col("tp") - F.col("p"), F.col("tq") - F.col("q")
        odds = F.ln((a + alpha) / (F.sum(a).over(w) + alpha * n)) - F.ln((b + alpha) / (F.sum(b).over(w) + alpha * n))
        model = grid.select("fold", *h, "token", odds.alias("o"))
        s = steps.join(model, ["fold", *h, "token"]).groupBy(seq).agg(F.sum("o").alias("s"))
        out = out.join(s, seq, "left").withColumn("score", F.col("score") + F.coalesce("s", F.lit(0.0))).drop("s")
    return out


def segments(tokens: DataFrame, seq: str = "user_id", bins: int = 3) -> DataFrame:
    """(seq, seg, token, length, dwell): runs of equal tokens; dwell is length - 1, at most bins - 1."""
    w = Window.partitionBy(seq).orderBy("pos")
    new = (~F.col("token").eqNullSafe(F.lag("token").over(w))) | (F.row_number().over(w) == 1)
    runs = tokens.withColumn("seg", F.sum(new.cast("int")).over(w)).groupBy(seq, "seg").agg(F.first("token").alias("token"), F.count(F.lit(1)).alias("length"))
    return runs.withColumn("dwell", F.least(F.col("length") - 1, F.lit(bins - 1)).cast("int"))


def dwell_entropy(tokens: DataFrame, seq: str = "user_id") -> DataFrame:
    c = segments(tokens, seq).groupBy(seq, "dwell").agg(F.count(F.lit(1)).alias("n"))
    t = F.sum("n")
    return c.groupBy(seq).agg(t.alias("n_segments"), (F.ln(t) - F.sum(F.col("n") * F.ln("n")) / t).alias("entropy"))


def semi_markov_tokens(tokens: DataFrame, seq: str = "user_id", bins: int = 3) -> DataFrame:
    """(seq, pos, token): segments as tokens of state and dwell bin, for the transition models above."""
    s = segments(tokens, seq, bins)
    return s.select(seq, F.col("seg").alias("pos"), F.concat_ws(":", "token", F.col("dwell").cast("string")).alias("token"))


def forbidden(odds: DataFrame, rare: float = 0.015, ratio: float = 2.5, penalty: float = 0.9) -> DataFrame:
    """log-odds with a penalty for steps that are rare among positives and clearly commoner among negatives."""
    p, q = F.sum("p").over(Window.partitionBy()), F.sum("q").over(Window.partitionBy())
    sp, sq = F.col("p") / p, F.col("q") / q
    bad = (sp < rare) & (sq > ratio * F.greatest(sp, F.lit(1e-9)))
    return odds.withColumn("log_odds", F.col("log_odds") - F.when(bad, F.lit(penalty)).otherwise(F.lit(0.0)))


def sign_states(value: Column, threshold: float = 0.05) -> Column:
    return F.when(value < -threshold, 0).when(value > threshold, 2).otherwise(1)


def signature(tokens: DataFrame, seq: str = "user_id") -> DataFrame:
    """(seq, bag, changes): sorted tokens and number of changes, the strata of the sequence null."""
    w = Window.partitionBy(seq).orderBy("pos")
    return tokens.withColumn("c", (F.col("token") != F.lag("token").over(w)).cast("int")).groupBy(seq).agg(F.array_sort(F.collect_list("token")).alias("bag"), F.coalesce(F.sum("c"), F.lit(0)).alias("changes"))
