"""Annotation support of pairs: weighted evidence, term overlap, information content, modules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import half_up
from .graph import written

#: Weights of the two standard scores.
PAIR_WEIGHTS = {"grade": 0.35, "association": 0.35, "terms": 0.20, "interaction": 0.10}
DIRECTED_WEIGHTS = {"grade": 0.40, "interaction": 0.25, "association": 0.20, "terms": 0.15}


#: Symbols of a class that one row holds, about.
MEMBERS = 256


def support_score(pairs: DataFrame, evidence: Mapping[str, DataFrame], weights: Mapping[str, float] = PAIR_WEIGHTS) -> DataFrame:
    """pairs (source, target) with each evidence's value in [0, 1], 0 where absent, and the weighted sum
    `support`. Evidence tables are (source, target, value)."""
    out = pairs
    for name, table in evidence.items():
        out = out.join(table.select("source", "target", F.col("value").alias(name)), ["source", "target"], "left").na.fill(0.0, [name])
    total = F.lit(0.0)
    for name in evidence:
        total = total + F.lit(weights[name]) * F.col(name)
    return out.withColumn("support", total)


def symmetric(pairs: DataFrame, value: str = "support") -> DataFrame:
    """The larger of both directions, a row per u < v."""
    return pairs.groupBy(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).agg(F.max(value).alias(value))


def consensus_tier(pairs: DataFrame, *sources: DataFrame) -> DataFrame:
    """pairs with tier: how many of the sources (source, target) hold the pair."""
    tier, out = F.lit(0), pairs
    for k, s in enumerate(sources):
        out = out.join(s.select("source", "target").distinct().withColumn(f"__in{k}", F.lit(1)), ["source", "target"], "left")
        tier = tier + F.coalesce(F.col(f"__in{k}"), F.lit(0))
    return out.withColumn("tier", tier).drop(*[f"__in{k}" for k in range(len(sources))])


def confidence_tier(score: str = "score"):
    return F.when(F.col(score) >= 3, "high").when(F.col(score) >= 1, "medium").otherwise("low")


#: Symbols and terms of a block that meets others in one task, about.
BLOCK_SYMBOLS, BLOCK_TERMS = 2048, 1 << 18
#: Pairs of a batch of rows; terms of two blocks up to which their pairs are matrix products.
ROWS, DENSE = 32768, 512
#: About the nanoseconds that it takes to compare two sets where they meet, to look at a pair of a block, and to count a common term there.
MEETING, PAIR, HIT = 500, 10, 10


def _met(sets: DataFrame, names: Sequence[str], columns, weighed: bool = False) -> DataFrame:
    """(u, v, shared, names...) of the pairs of symbols u < v with a common term. sets: (symbol, n, s, terms), terms an array of structs
    (term, ic), each term once; columns: from the pairs' (shared, c, r, nu, nv, su, sv), as arrays, the columns' arrays, or None where no
    row stays, beside which rows stay (None: all). c and r are sum and largest of the common terms' ic, where they are weighed.

    A block of symbols meets a block in one task, which adds up a matrix of their pairs term by term; pairs are not shuffled."""
    spark = sets.sparkSession
    sets = written(sets.where("symbol is not null"), "term-sets")
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("t")).first()
    blocks = max(1, -(-total.n // BLOCK_SYMBOLS), -(-(total.t or 0) // BLOCK_TERMS))
    held = sets.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("symbol", "n", "s", "terms")).alias("x"))
    held = written(held, "term-blocks")
    pairs = spark.range(blocks).select(F.col("id").alias("p"), F.explode(F.sequence("id", F.lit(blocks - 1).cast("long"))).alias("q"))
    pairs = pairs.join(held.select(F.col("b").alias("p"), F.col("x").alias("one")), "p").join(held.select(F.col("b").alias("q"), F.col("x").alias("two")), "q")
    rows = pairs.repartition(min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), blocks * (blocks + 1) // 2))
    kind = sets.schema["symbol"].dataType.simpleString()

    def block(x):
        symbols, terms = x.field("symbol"), x.field("terms")
        flat = terms.flatten()
        return symbols, x.field("n").to_numpy().astype(float), x.field("s").to_numpy(), flat.field("term"), flat.field("ic"), np.repeat(np.arange(len(x)), pc.list_value_length(terms).to_numpy())

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                own = b.column("p")[row] == b.column("q")[row]
                one, two = (block(b.column(c)[row].values) for c in ("one", "two"))
                symbols = pa.concat_arrays([one[0], two[0]])
                order = pc.array_sort_indices(symbols).to_numpy()
                symbols = symbols.take(pa.array(order))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                first, second = place[: len(one[0])], place[len(one[0]) :]
                codes = pa.concat_arrays([one[3], two[3]]).dictionary_encode().indices.to_numpy()
                ic = np.r_[one[4].to_numpy(), two[4].to_numpy()]
                code = codes[: len(one[3])], codes[len(one[3]) :]
                at = [one[5][np.argsort(code[0], kind="stable")], two[5][np.argsort(code[1], kind="stable")]]
                size = int(codes.max(initial=-1)) + 1
                ends = [np.r_[0, np.cumsum(np.bincount(c, minlength=size))] for c in code]
                worth = np.zeros(size)
                worth[codes] = ic
                shape = len(one[0]), len(two[0])
                count, c, r = np.zeros(shape, np.int32), np.zeros(shape) if weighed else None, np.zeros(shape) if weighed else None
                if dense := size <= DENSE:  # sums as matrix products
                    member = [np.zeros((x, size)) for x in shape]
                    for k in (0, 1):
                        member[k][(one, two)[k][5], code[k]] = 1
                    count = (member[0] @ member[1].T).astype(np.int32)
                    c = (member[0] * worth) @ member[1].T if weighed else None
                for t in np.argsort(worth, kind="stable").tolist() if weighed or not dense else ():  # the largest last
                    i, j = (at[k][ends[k][t] : ends[k][t + 1]] for k in (0, 1))
                    if len(i) and len(j):
                        cells = (i[:, None] * shape[1] + j[None]).ravel()
                        if not dense:
                            count.ravel()[cells] += 1
                            if weighed:
                                c.ravel()[cells] += worth[t]
                        if weighed:
                            r.ravel()[cells] = worth[t]
                if own:  # the one block is the other: a symbol's places are next to each other
                    count[first[:, None] // 2 >= second[None] // 2] = 0
                step = max(1, ROWS // shape[1])
                for low in range(0, shape[0], step):
                    i, j = np.nonzero(count[low : low + step])
                    i += low
                    cells = i * shape[1] + j
                    k = count.ravel().take(cells)
                    made, stay = columns(k, c.ravel().take(cells) if weighed else None, r.ravel().take(cells) if weighed else None, one[1].take(i), two[1].take(j), one[2].take(i), two[2].take(j))
                    x, y = first.take(i), second.take(j)
                    u, v = np.minimum(x, y), np.maximum(x, y)
                    made = [k.astype(np.int64), *made]
                    if stay is not None:
                        u, v, made = u[stay], v[stay], [m[stay] for m in made]
                    yield pa.RecordBatch.from_arrays([symbols.take(pa.array(u)), symbols.take(pa.array(v)), *map(pa.array, made)], ["u", "v", "shared", *names])

    return rows.mapInArrow(run, ", ".join([f"u {kind}, v {kind}, shared long", *(f"{c} double" for c in names)]))


def _term_sets(t: DataFrame) -> DataFrame:
    """(symbol, n, s, terms) of distinct (symbol, term, ic)."""
    terms = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "ic")))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("ic").alias("s"), terms.alias("terms"))


def _rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else half_up(x, digits)


def shared_terms(terms: DataFrame, digits: int | None = None) -> DataFrame:
    """(u, v, shared, jaccard) of symbols u < v with a common term of (symbol, term), block against block; pairs without one have 0 and no
    row. jaccard is rounded to `digits` as round() does, if given."""

    def columns(k, c, r, nu, nv, su, sv):
        return [_rounded(k / (nu + nv - k), digits)], None

    return _met(_term_sets(terms.select("symbol", "term").distinct().withColumn("ic", F.lit(0.0))), ["jaccard"], columns)


def similar_terms(terms: DataFrame, least: float, hot: int = 10_000, digits: int | None = None) -> DataFrame:
    """The rows of shared_terms() whose jaccard is at least `least` > 0, without going through common terms.

    A symbol's terms are put in order from the rarest. Two sets that are so similar share one of the first
    n - ceil(least * n) + 1 terms of each, so only those prefixes meet; a pair whose sizes are too different is
    not counted, and the sets of the rest are compared once, where they meet at their first common prefix
    term. A term that is in over `hot` prefixes is dealt out in squares of that many symbols. Symbols with equal sets are
    compared as one, and only the pairs that hold are dealt out to them, a block of symbols against a block. Where so many
    prefixes would meet that it costs more than to go through all common terms as shared_terms() does, that is done.
    jaccard is rounded to `digits` as round() does, if given."""
    t = written(terms.where("symbol is not null").select("symbol", "term").distinct(), "terms")  # read twice
    rare = t.join(t.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    own = rare.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("own"))
    # equal sets are one class, compared once; its symbols lie in blocks
    own = written(own, "term-sets")
    sets = own.groupBy("own").agg(F.min("symbol").alias("symbol"))
    n = F.size("own")
    upto = (n - F.ceil(least * n - 1e-9) + 1).cast("int")
    first = sets.select("symbol", "own", F.posexplode(F.slice("own", 1, upto)).alias("at", "term"))
    squares = lambda df: df.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    if MEETING * squares(first) > PAIR * float(own.count()) ** 2 + HIT * squares(own.select(F.explode("own").alias("term"))):

        def columns(k, c, r, nu, nv, su, sv):
            j = k / (nu + nv - k)
            return [_rounded(j, digits)], j >= least - 1e-9

        return _met(own.select("symbol", n.cast("long").alias("n"), F.lit(0.0).alias("s"), F.transform("own", lambda x: F.struct(x.alias("term"), F.lit(0.0).alias("ic"))).alias("terms")), ["jaccard"], columns)
    block = F.pmod(F.xxhash64("symbol"), F.ceil(F.col("n") / MEMBERS).cast("long")).alias("block")
    held = own.join(own.groupBy("own").agg(F.min("symbol").alias("class"), F.count(F.lit(1)).alias("n")), "own")
    blocks = written(held.groupBy("class", "n", block).agg(F.collect_list("symbol").alias("symbols")), "term-classes")

    parts = first.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / hot).cast("long").alias("parts"))
    dealt = first.join(parts, "term").withColumn("part", F.pmod(F.xxhash64("symbol"), F.col("parts")))
    others = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    a = dealt.select("term", F.col("part").alias("pu"), F.explode(others).alias("pv"), F.col("symbol").alias("u"), F.col("own").alias("x"), F.col("at").alias("i"))
    b = dealt.select("term", F.explode(others).alias("pu"), F.col("part").alias("pv"), F.col("symbol").alias("v"), F.col("own").alias("y"), F.col("at").alias("j"))
    met = a.join(b, ["term", "pu", "pv"]).where("u < v")
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    met = met.where(small >= least * large - 1e-9)
    # at the first term that both prefixes hold, and there alone
    earlier = F.arrays_overlap(F.slice("x", F.lit(1), F.col("i")), F.slice("y", F.lit(1), F.col("j")))
    shared = F.size(F.array_intersect("x", "y"))
    rows = met.where(~earlier).select("u", "v", shared.cast("long").alias("shared"), (shared / (F.size("x") + F.size("y") - shared)).alias("jaccard"))
    alike = rows.where(F.col("jaccard") >= least - 1e-9)
    if digits is not None:  # once a pair of sets
        alike = alike.withColumn("jaccard", F.round("jaccard", digits))
    within = sets.select(F.col("symbol").alias("u"), F.col("symbol").alias("v"), F.size("own").cast("long").alias("shared"), F.lit(1.0).alias("jaccard"))

    # every symbol of one class with every one of the other, a block against a block a row
    end = lambda c, name: blocks.select(F.col("class").alias(c), F.col("block").alias(f"b{c}"), F.col("symbols").alias(name))
    both = alike.unionByName(within).join(end("u", "x"), "u").join(end("v", "y"), "v").where("u <> v or bu <= bv")
    both = both.repartition("u", "bu", "v", "bv")
    pairs = both.select("u", "v", "bu", "bv", "y", "shared", "jaccard", F.explode("x").alias("p")).select("u", "v", "bu", "bv", "shared", "jaccard", "p", F.explode("y").alias("q"))
    pairs = pairs.where("u <> v or bu <> bv or p < q")
    return pairs.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "shared", "jaccard")


def information_content(terms: DataFrame) -> DataFrame:
    """(term, n, ic): ln((symbols + 1) / (symbols of the term + 1))."""
    t = terms.select("symbol", "term").distinct()
    total = t.agg(F.count_distinct("symbol").alias("total"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("term", "n", F.ln((F.col("total") + 1) / (F.col("n") + 1)).alias("ic"))


def semantic_similarity(terms: DataFrame, digits: int | None = None, only: Sequence[str] = ("jaccard", "lin", "resnik", "overlap")) -> DataFrame:
    """(u, v, jaccard, lin, resnik, overlap), or `only` some of the four, of pairs with a common term: twice the common content over
    both, the largest common content, the common terms over the smaller set; rounded to `digits` as round() does, if given."""

    def columns(k, c, r, nu, nv, su, sv):
        s = su + sv
        made = {"jaccard": lambda: k / (nu + nv - k), "lin": lambda: np.where(s > 0, 2 * c / np.where(s > 0, s, 1.0), 0.0), "resnik": lambda: r, "overlap": lambda: k / np.minimum(nu, nv)}
        return [_rounded(made[x](), digits) for x in only], None

    terms = written(terms.select("symbol", "term").distinct(), "terms")  # read three times
    t = terms.join(information_content(terms).select("term", "ic"), "term")
    return _met(_term_sets(t), only, columns, True).drop("shared")


def semantic_feature(similarity: DataFrame) -> DataFrame:
    """The blend .55 lin + .3 jaccard + .15 overlap, with Resnik over its largest."""
    top = similarity.agg(F.max("resnik").alias("top"))
    rows = similarity.crossJoin(F.broadcast(top))
    return rows.select("u", "v", (0.55 * F.col("lin") + 0.3 * F.col("jaccard") + 0.15 * F.col("overlap")).alias("semantic"),
                       F.when(F.col("top") > 0, F.col("resnik") / F.col("top")).otherwise(F.lit(0.0)).alias("resnik_share"))


def top_terms(terms: DataFrame, most: int, among: DataFrame | None = None) -> DataFrame:
    """The terms of most symbols, ties by term, counted among the given symbols if there are."""
    rows = terms.join(among.select("symbol").distinct(), "symbol", "left_semi") if among is not None else terms
    return rows.groupBy("term").agg(F.count_distinct("symbol").alias("n")).orderBy(F.desc("n"), "term").limit(most)


def select_modules(terms: DataFrame, least: int, most: int, cap: int) -> DataFrame:
    """(module, n, symbols): terms of least to most symbols, largest first, ties by term, at most cap;
    of terms with the same symbols the first."""
    sets = terms.groupBy(F.col("term").alias("module")).agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    sized = sets.withColumn("n", F.size("symbols")).where(F.col("n").between(least, most))
    w = Window.partitionBy("symbols").orderBy("module")
    first = sized.withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.orderBy(F.desc("n"), "module").limit(cap).select("module", "n", "symbols")


def assign_module(terms: DataFrame, chosen: DataFrame, other: str = "OTHER") -> DataFrame:
    """(symbol, module): the first, by name, of a symbol's terms among the chosen, else `other`."""
    hit = terms.join(chosen.select("term"), "term").groupBy("symbol").agg(F.min("term").alias("m"))
    return terms.select("symbol").distinct().join(hit, "symbol", "left").select("symbol", F.coalesce("m", F.lit(other)).alias("module"))


def positive_incidence(edges: DataFrame) -> DataFrame:
    """(symbol, rate): (positive edges + 1) / (edges + 2) of each node in either role."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("symbol"), "label")
    return ends.groupBy("symbol").agg(((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2)).alias("rate"))


def anchors(pairs: DataFrame, floor: float = 0.15, share: float = 0.75) -> DataFrame:
    """Symbols whose best support reaches both the floor and the quantile `share` of all."""
    ends = pairs.select(F.explode(F.array("source", "target")).alias("symbol"), "support").groupBy("symbol").agg(F.max("support").alias("strength"))
    cut = ends.agg(F.percentile("strength", F.lit(share)).alias("cut"))
    return ends.crossJoin(F.broadcast(cut)).where(F.col("strength") >= F.greatest(F.lit(floor), F.col("cut"))).select("symbol", "strength")


def anchor_weights(symbols: DataFrame, listed: DataFrame, hit: DataFrame) -> DataFrame:
    """1, and 1.6 more for listed symbols, 0.8 more for those that hold an anchor term."""
    rows = symbols.join(listed.select("symbol").distinct().withColumn("l", F.lit(1.6)), "symbol", "left").join(hit.select("symbol").distinct().withColumn("h", F.lit(0.8)), "symbol", "left")
    return rows.select("symbol", (1 + F.coalesce("l", F.lit(0.0)) + F.coalesce("h", F.lit(0.0))).alias("weight"))


def obstruction(edges: DataFrame, charts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges (source, target, margin) with the mean margin of their pair of charts, how far they are from
    it, exp(-obstruction), the pair's share of all edges, and whether it joins two charts or an unknown."""
    for end in ("source", "target"):
        edges = edges.join(charts.select(*keys, F.col("node").alias(end), F.col("chart").alias(f"c_{end}")), [*keys, end], "left").na.fill(-1, [f"c_{end}"])
    pair = [*keys, "c_source", "c_target"]
    means = edges.groupBy(*pair).agg(F.avg("margin").alias("__m"), F.count(F.lit(1)).alias("__n"))
    total = means.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    means = means.join(total, list(keys)) if keys else means.crossJoin(F.broadcast(total))  # one row
    gap = F.abs(F.col("margin") - F.col("__m"))
    return edges.join(means, pair).select(
        *keys, "source", "target", gap.alias("obstruction"), F.exp(-gap).alias("compatibility"), (F.col("__n") / F.col("__all")).alias("frequency"),
        (F.col("c_source") != F.col("c_target")).cast("int").alias("boundary"), F.least("c_source", "c_target").alias("lowest_chart"),
    )


def conditional_delta(df: DataFrame, flag: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positive rate where flag is set less where it is not."""
    hit = F.avg(F.when(F.col(flag) > 0, F.col(label).cast("double")))
    miss = F.avg(F.when(F.col(flag) <= 0, F.col(label).cast("double")))
    return df.groupBy(*keys).agg((hit - miss).alias("rate_delta"))


def tercile_delta(df: DataFrame, value: str, label: str, module: str, least: int = 8) -> DataFrame:
    """(module, n, delta): positive rate in the upper third of value less that in the lower, within the
    module where it has `least` rows, else over all."""
    cut = df.groupBy(module).agg(F.count(F.lit(1)).alias("n"), F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    rows = df.join(cut, module)
    y = F.col(label).cast("double")
    own = rows.groupBy(module, "n").agg((F.avg(F.when(F.col(value) >= F.col("c")[1], y)) - F.avg(F.when(F.col(value) <= F.col("c")[0], y))).alias("own"))
    over = df.agg(F.percentile(value, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    g = df.crossJoin(F.broadcast(over)).agg((F.avg(F.when(F.col(value) >= F.col("c")[1], y)) - F.avg(F.when(F.col(value) <= F.col("c")[0], y))).alias("all"))
    return own.crossJoin(F.broadcast(g)).select(module, "n", F.when(F.col("n") >= least, F.coalesce("own", "all")).otherwise(F.col("all")).alias("delta"))
