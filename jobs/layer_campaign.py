"""Campaign over the layers of an embedding: which edge scores tell edges within a label from others, in
which domain, split and layer, and do they beat every null family?

    python -m jobs.layer_campaign --embeddings .../embeddings.parquet --out .../campaign [--config settings.json]

Every node gets hashed partners, every edge three scores in each layer: minus the distance of its ends, their
cosine and minus the gap of their norms. Written are `nulls`, `results` with their verdicts, both by domain
and split, and `summary` by split. A run replaces the partitions it makes, so that a rerun gives the same
files' worth of rows, and a run over some domains (setting `domains`) leaves the others as they were.

Vectors that are null or hold nulls make no edge scores; a slice with one class has no AUC.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._job import config, log, main, setting, written
from orrery.functions import expressions as X
from orrery.operators import graph
from orrery.plans import audit, draws, screen

KEYS = ["domain", "split", "layer"]


def edge_scores(points: DataFrame, nodes: DataFrame, partners: int, grid: int) -> DataFrame:
    """(edge, y, domain, split, layer, distance, cosine, norms, stratum) of the partner edges, scores on the grid;
    the stratum is the quarter of the slice's distances."""
    ends = lambda e, c: nodes.select(F.col("vec_id").alias(e), F.col("label").alias(c))
    side = lambda e, v: points.select(F.col("vec_id").alias(e), "layer", F.col("vec").alias(v))
    edges = screen.partner_edges(nodes, partners).join(ends("u", "lu"), "u").join(ends("v", "lv"), "v")
    both = edges.join(side("u", "x"), "u").join(side("v", "z"), ["v", "layer"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    norm = lambda a: F.sqrt(dot(a, a))
    on_grid = lambda c: F.round(c * grid).cast("long")
    rows = both.select(
        "u", "v", "layer", (F.col("lu") == F.col("lv")).cast("int").alias("y"), (F.col("lu") % 3).alias("domain"), on_grid(X.distance("x", "z")).alias("far"),
        on_grid(F.try_divide(dot("x", "z"), norm("x") * norm("z"))).alias("cosine"), on_grid(F.abs(norm("x") - norm("z"))).alias("gap"),
    )
    split = screen.split_masks(rows)
    cuts = split.groupBy(*KEYS).agg(F.percentile("far", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    quarter = sum(((F.col("far") > F.col("q")[i]).cast("int") for i in range(3)), F.lit(0))
    return split.join(cuts, KEYS).select(F.concat_ws("-", "u", "v").alias("edge"), "y", *KEYS, (-F.col("far")).alias("distance"), "cosine", (-F.col("gap")).alias("norms"), quarter.alias("stratum"))


def run(spark: SparkSession, embeddings: str, out: str, settings: Mapping | None = None) -> DataFrame:
    """Screen the embeddings of a Parquet table; returns all results, read back."""
    s = config("layer_campaign", settings)
    graph.checkpoints(spark)
    with setting(spark, "spark.sql.unionOutputPartitioning", "false"):
        table = spark.read.parquet(embeddings)
        log.info("read %s: %d embeddings", embeddings, table.count())
        nodes = table.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")).where("vec is not null and not exists(vec, x -> x is null)")
        cut = F.array(*[F.slice("vec", 1 + s["width"] * k, s["width"]) for k in range(s["layers"])])
        points = nodes.select("vec_id", F.posexplode(cut).alias("layer", "vec"))
        edges = edge_scores(points, nodes.select("vec_id", "label"), s["partners"], s["grid"])
        if s["domains"] is not None:
            edges = edges.where(F.col("domain").isin(s["domains"]))
        edges = edges.checkpoint()
        log.info("made %d edges by slice", edges.count())
        scores: dict[str, Column] = {h: F.col(h) for h in ("distance", "cosine", "norms")}
        seen, nulls = draws.drawn_screen(edges, "edge", "y", scores, KEYS, "stratum", s["replicates"])
        nulls = written(nulls, f"{out}/nulls", ["domain", "split"], "null values")
        if s["domains"] is not None:
            nulls = nulls.where(F.col("domain").isin(s["domains"]))
        results = written(draws.verdicts(seen, nulls, KEYS), f"{out}/results", ["domain", "split"], "results")
        rows = results.withColumn("null_gap", F.col("strict_margin"))
        written(audit.summary(rows, ["hypothesis", "split"]), f"{out}/summary", ["split"], "a summary")
        return results


if __name__ == "__main__":
    main("layer_campaign", run, ["embeddings", "out"])
