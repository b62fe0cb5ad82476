"""Graphs as edge tables: (source, target) for directed ones, (u, v) with u < v for undirected ones,
with slice columns `keys` in front where several graphs share a table. Everything here is joins and
aggregates, so a graph may be larger than a machine; only components() goes in rounds."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import correlation


def undirected(edges: DataFrame, keys: Sequence[str] = (), source: str = "source", target: str = "target") -> DataFrame:
    rows = edges.where(F.col(source) != F.col(target))
    return rows.select(*keys, F.least(source, target).alias("u"), F.greatest(source, target).alias("v")).distinct()


def both_ways(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(a, b) for each direction of an undirected edge."""
    return edges.select(*keys, F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select(*keys, "e.a", "e.b")


def degrees(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return both_ways(edges, keys).groupBy(*keys, F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def top_nodes(edges: DataFrame, cap: int, source: str = "source", target: str = "target") -> DataFrame:
    """The cap nodes of most edges in either role, ties by id."""
    ends = edges.select(F.explode(F.array(source, target)).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(cap)


def triangles(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(x, y, z) with x < y < z, once each: every edge leaves its end of lower degree (ties by id), so
    that no node starts more pairs than the root of twice the edges."""
    deg = degrees(edges, keys)
    on = list(keys)
    ranked = (
        edges.join(deg.select(*keys, F.col("node").alias("u"), F.col("degree").alias("du")), [*on, "u"])
        .join(deg.select(*keys, F.col("node").alias("v"), F.col("degree").alias("dv")), [*on, "v"])
    )
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = ranked.select(*keys, F.when(low, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("t"))
    one, two = out.withColumnRenamed("t", "p"), out.withColumnRenamed("t", "q")
    wedge = one.join(two, [*on, "s"]).where("p < q")
    closing = edges.select(*keys, F.col("u").alias("p"), F.col("v").alias("q"))
    found = wedge.join(closing, [*on, "p", "q"]).select(*keys, F.array_sort(F.array("s", "p", "q")).alias("t"))
    return found.select(*keys, F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


def local_clustering(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(node, degree, clustering): links among neighbours over the possible; 0 under two neighbours."""
    corners = triangles(edges, keys).select(*keys, F.explode(F.array("x", "y", "z")).alias("node")).groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("t"))
    rows = degrees(edges, keys).join(corners, [*keys, "node"], "left")
    k = F.col("degree")
    return rows.select(*keys, "node", "degree", F.when(k > 1, 2.0 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def open_pairs(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(node, open_pairs): neighbour pairs that aren't linked, a stand-in for betweenness."""
    c = local_clustering(edges, keys)
    k = F.col("degree")
    return c.select(*keys, "node", F.round((1 - F.col("clustering")) * k * (k - 1) / 2).cast("long").alias("open_pairs"))


def two_hop_reach(edges: DataFrame, n_nodes: Column | int, keys: Sequence[str] = ()) -> DataFrame:
    """(node, reach): distinct nodes two steps away, itself left out, over the others."""
    b = both_ways(edges, keys)
    ends = b.join(b.select(*keys, F.col("a").alias("b"), F.col("b").alias("c")), [*keys, "b"]).where("a <> c").select(*keys, "a", "c").distinct()
    n = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    return ends.groupBy(*keys, F.col("a").alias("node")).agg((F.count(F.lit(1)) / (n - 1)).alias("reach"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Of each source the targets, and the share that points back."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(1).alias("back"))
    rows = edges.select("source", "target").distinct().join(back.distinct(), ["source", "target"], "left")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("out_degree"), F.avg(F.coalesce("back", F.lit(0)).cast("double")).alias("reciprocity"))


def with_ends(edges: DataFrame, nodes: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Edges with columns of both end nodes, as <column>_u and <column>_v."""
    for end in ("u", "v"):
        edges = edges.join(nodes.select(*keys, F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), [*keys, end], "left")
    return edges


def forman_curvature(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = with_ends(edges, degrees(edges, keys), ["degree"], keys)
    return rows.select(*keys, "u", "v", (4 - F.col("degree_u") - F.col("degree_v")).alias("curvature"))


def edge_overlap(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(u, v, shared, jaccard, bridge): common neighbours of an edge's ends, over all neighbours of
    either, and what is missing to 1."""
    t = triangles(edges, keys)
    sides = t.select(*keys, F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("y").alias("v")), F.struct(F.col("x").alias("u"), F.col("z").alias("v")), F.struct(F.col("y").alias("u"), F.col("z").alias("v")))).alias("e"))
    shared = sides.groupBy(*keys, F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("shared"))
    rows = with_ends(edges, degrees(edges, keys), ["degree"], keys).join(shared, [*keys, "u", "v"], "left").na.fill(0, ["shared"])
    j = F.col("shared") / (F.col("degree_u") + F.col("degree_v") - F.col("shared"))
    return rows.select(*keys, "u", "v", "shared", j.alias("jaccard"), (1 - j).alias("bridge"))


def assortativity(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    edges = written(edges.select(*keys, "u", "v"), "edges")  # read three times
    rows = with_ends(edges, degrees(edges, keys), ["degree"], keys)
    ends = rows.select(*keys, F.explode(F.array(F.struct(F.col("degree_u").alias("a"), F.col("degree_v").alias("b")), F.struct(F.col("degree_v").alias("a"), F.col("degree_u").alias("b")))).alias("e"))
    return ends.groupBy(*keys).agg(correlation("e.a", "e.b").alias("assortativity"))


_FOLDERS: dict[str, str] = {}


def checkpoints(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, in which rounds are written. A local session that names
    none (tests) gets a temporary one, deleted at its end; on a cluster that would be each machine's own,
    so one must be named."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, _FOLDERS[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_FOLDERS[app])
    return _FOLDERS[app]


def _clear(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # best effort, at the program's end
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the checkpoint folder, read back: its lineage ends there. The tables of a program are
    deleted at its end."""
    spark = df.sparkSession
    folder = f"{checkpoints(spark)}/orrery-core-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS[folder] = folder
        atexit.register(_clear, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    with tidied(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy(spark: SparkSession) -> int:
    """Parts for steps whose work is not in their bytes. A number that is given is kept; without one adaptive execution
    puts small parts together, and few tasks have all the work."""
    return 8 * spark.sparkContext.defaultParallelism


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """What ends within leaves no shuffle files; else they stay until the driver's next collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def numbered(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the place of each row in order of a column without ties, from 0. Rows are dealt out by ranges
    of the column, counted where they are and moved up by the ranges before: no task sees all rows. The
    ranges are written to the session's checkpoint folder, so that they stay as they are."""
    checkpoints(df.sparkSession)
    ranged = df.repartitionByRange(column).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.withColumn("__before", before).drop("__n"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return ranged.withColumn("__at", place).join(starts, "__part").withColumn(out, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def components(edges: DataFrame, keys: Sequence[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node that can be reached; all slices go through the rounds together.
    A round takes the least label of the neighbours and then the label's own label. nodes adds ones
    without edges. Rounds are written to the session's checkpoint folder."""
    checkpoints(edges.sparkSession)
    on = list(keys)
    links = both_ways(edges, keys).checkpoint()
    every = links.select(*keys, F.col("a").alias("node")).distinct()
    labels = (every.unionByName(nodes.select(*keys, "node")).distinct() if nodes is not None else every).withColumn("component", F.col("node")).checkpoint()
    while True:
        near = links.join(labels.select(*keys, F.col("node").alias("b"), "component"), [*on, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("m"))
        moved = labels.join(near, [*on, "node"], "left").select(*keys, "node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = moved.select(*keys, F.col("node").alias("c"), F.col("c").alias("cc"))
        now = moved.join(jump, [*on, "c"], "left").select(*keys, "node", "was", F.least("c", F.coalesce("cc", "c")).alias("component")).checkpoint()
        if now.where("component <> was").isEmpty():
            return now.select(*keys, "node", "component")
        labels = now.drop("was")


def cycle_rank(edges: DataFrame, keys: Sequence[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """(n_nodes, n_edges, n_components, rank) of each slice: edges - nodes + components."""
    c = components(edges, keys, nodes).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("component").alias("n_components"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    rows = c.join(m, list(keys), "left") if keys else c.crossJoin(m)
    rows = rows.na.fill(0, ["n_edges"])
    rank = F.greatest(F.lit(0), F.col("n_edges") - F.col("n_nodes") + F.col("n_components"))
    return rows.select(*keys, "n_nodes", "n_edges", "n_components", rank.alias("rank"))


# motifs of directed graphs: (kind, nodes)


def _kind(df: DataFrame, kind: str, *nodes: Column | str) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.array(*[F.col(n) if isinstance(n, str) else n for n in nodes]).alias("nodes")).distinct()


def _e(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where("source <> target").select(F.col("source").alias(a), F.col("target").alias(b)).distinct()


def feed_forward_loops(edges: DataFrame) -> DataFrame:
    """a->b, b->c, a->c."""
    found = _e(edges, "a", "b").join(_e(edges, "b", "c"), "b").join(_e(edges, "a", "c"), ["a", "c"])
    return _kind(found, "feed_forward", "a", "b", "c")


def feedback_triads(edges: DataFrame) -> DataFrame:
    """a->b->c->a, as a sorted triple."""
    found = _e(edges, "a", "b").join(_e(edges, "b", "c"), "b").join(_e(edges, "c", "a"), ["a", "c"]).where("a < b and a < c and b <> c")
    return found.select(F.lit("feedback").alias("kind"), F.array_sort(F.array("a", "b", "c")).alias("nodes")).distinct()


def chains(edges: DataFrame) -> DataFrame:
    """a->b->c without a->c."""
    found = _e(edges, "a", "b").join(_e(edges, "b", "c"), "b").where("a <> c").join(_e(edges, "a", "c"), ["a", "c"], "left_anti")
    return _kind(found, "chain", "a", "b", "c")


def bifans(edges: DataFrame) -> DataFrame:
    """a->x, a->y, b->x, b->y with a < b and x < y."""
    common = _e(edges, "a", "x").join(_e(edges, "b", "x"), "x").where("a < b")
    found = common.join(common.withColumnRenamed("x", "y"), ["a", "b"]).where("x < y and x <> b and y <> b and x <> a and y <> a")
    return _kind(found, "bifan", "a", "b", "x", "y")


def multi_inputs(edges: DataFrame) -> DataFrame:
    """a->t and b->t, a < b, without an edge between a and b."""
    pairs = _e(edges, "a", "t").join(_e(edges, "b", "t"), "t").where("a < b")
    linked = undirected(edges).select(F.col("u").alias("a"), F.col("v").alias("b"))
    return _kind(pairs.join(linked, ["a", "b"], "left_anti"), "multi_input", "a", "b", "t")


def motif_panel(edges: DataFrame) -> DataFrame:
    out = feed_forward_loops(edges)
    for f in (feedback_triads, chains, bifans, multi_inputs):
        out = out.unionByName(f(edges))
    return out


def motif_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind, n_a, n_b, n_both) of two motif panels."""
    rows = a.withColumn("ia", F.lit(1)).join(b.withColumn("ib", F.lit(1)), ["kind", "nodes"], "full")
    return rows.groupBy("kind").agg(F.count("ia").alias("n_a"), F.count("ib").alias("n_b"), F.count(F.when(F.col("ia").isNotNull() & F.col("ib").isNotNull(), 1)).alias("n_both"))


def smoothed_rates(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, rate): share of positives with one of each kind added."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), ((F.sum(label) + 1.0) / (F.count(F.lit(1)) + 2)).alias("rate"))


# modules


def collapse(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct edges between the modules of (node, module), those inside one left out."""
    for end in ("source", "target"):
        edges = edges.join(modules.select(F.col("node").alias(end), F.col("module").alias(f"m_{end}")), end)
    return edges.where("m_source <> m_target").select(F.col("m_source").alias("source"), F.col("m_target").alias("target")).distinct()


def module_density(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, n, n_edges, density): ordered pairs inside a module that are edges."""
    size = modules.groupBy("module").agg(F.count_distinct("node").alias("n"))
    inside = edges.where("source <> target").select("source", "target").distinct()
    for end in ("source", "target"):
        inside = inside.join(modules.select(F.col("node").alias(end), F.col("module").alias(f"m_{end}")), end)
    inside = inside.where("m_source = m_target").groupBy(F.col("m_source").alias("module")).agg(F.count(F.lit(1)).alias("n_edges"))
    rows = size.join(inside, "module", "left").na.fill(0, ["n_edges"])
    n = F.col("n")
    return rows.select("module", "n", "n_edges", F.when(n > 1, F.col("n_edges") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"))


def modularity(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Newman's modularity of an undirected graph under (node, module)."""
    m = edges.count()
    deg = degrees(edges).join(modules, "node").groupBy("module").agg(F.sum("degree").alias("d"))
    e = with_ends(edges, modules, ["module"]).where("module_u = module_v").groupBy(F.col("module_u").alias("module")).agg(F.count(F.lit(1)).alias("e"))
    q = F.sum(F.coalesce("e", F.lit(0)) / F.lit(float(max(m, 1))) - F.pow(F.col("d") / F.lit(2.0 * max(m, 1)), 2))
    return deg.join(e, "module", "left").agg(q.alias("modularity"))


# weights


def margin(edges: DataFrame) -> DataFrame:
    """(source, target, w, margin): weight less that of the opposite edge."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("w").alias("wb"))
    return edges.join(back, ["source", "target"], "left").select("source", "target", "w", (F.col("w") - F.coalesce("wb", F.lit(0))).alias("margin"))


def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges (u, v, margin) pointed from u to v where margin >= 0, else back."""
    ahead = F.col("margin") >= 0
    return edges.select(F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("source"), F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("target"), F.abs("margin").alias("w"))


def triad_closure(weights: DataFrame) -> DataFrame:
    """(i, j, closure): sum of products over common neighbours of a symmetric (a, b, w), scaled by the
    largest, the diagonal left out."""
    w1, w2 = weights.select(F.col("a").alias("i"), F.col("b").alias("k"), F.col("w").alias("w1")), weights.select(F.col("a").alias("k"), F.col("b").alias("j"), F.col("w").alias("w2"))
    s = w1.join(w2, "k").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("w1") * F.col("w2")).alias("s"))
    top = s.agg(F.max("s").alias("top"))
    return s.crossJoin(F.broadcast(top)).select("i", "j", F.when(F.col("top") > 0, F.col("s") / F.col("top")).otherwise(F.lit(0.0)).alias("closure"))


def row_stochastic(weights: DataFrame) -> DataFrame:
    """(i, j, p): weights (i, j, w) over the sum of their row."""
    return weights.select("i", "j", (F.col("w") / F.sum("w").over(Window.partitionBy("i"))).alias("p"))


def matrix_product(a: DataFrame, b: DataFrame, value: str = "p") -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col(value).alias("x")), b.select(F.col("i").alias("k"), "j", F.col(value).alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias(value))


def diffusion_distance(transition: DataFrame, steps: int = 2) -> DataFrame:
    """(u, v, distance) of pairs u < v that share a node after `steps` steps: between rows of the power;
    ||x - y||^2 = |x|^2 + |y|^2 - 2xy, so rows are never made dense."""
    power = transition
    for _ in range(steps - 1):
        power = matrix_product(power, transition)
    squares = power.groupBy("i").agg(F.sum(F.col("p") * F.col("p")).alias("s"))
    x, y = power.select(F.col("i").alias("u"), "j", F.col("p").alias("x")), power.select(F.col("i").alias("v"), "j", F.col("p").alias("y"))
    cross = x.join(y, "j").where("u < v").groupBy("u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    rows = cross.join(squares.select(F.col("i").alias("u"), F.col("s").alias("su")), "u").join(squares.select(F.col("i").alias("v"), F.col("s").alias("sv")), "v")
    return rows.select("u", "v", F.sqrt(F.greatest(F.lit(0.0), F.col("su") + F.col("sv") - 2 * F.col("c"))).alias("distance"))


def hop_distances(edges: DataFrame, most: int) -> DataFrame:
    """(u, v, hops) up to `most` steps over undirected edges, by joins of a growing frontier."""
    step = both_ways(edges)
    seen = step.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).alias("hops"))
    front = seen
    for k in range(2, most + 1):
        ahead = front.select("u", F.col("v").alias("a")).join(step, "a").select("u", F.col("b").alias("v")).where("u <> v").distinct()
        front = ahead.join(seen.select("u", "v"), ["u", "v"], "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def hop_matrix(edges: DataFrame, nodes: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(source, target, hops) of all pairs of the given nodes, a bounded selection: steps over edges between
    them, whatever their direction; unreachable pairs have one more than the farthest, or the number of
    nodes where there is no edge. The frontier goes in checkpointed rounds until nothing is new."""
    n = nodes.select("node").distinct()
    inside = edges.join(n.withColumnRenamed("node", source), source, "left_semi").join(n.withColumnRenamed("node", target), target, "left_semi")
    step = both_ways(undirected(inside, (), source, target)).distinct()
    checkpoints(edges.sparkSession)
    seen = step.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).alias("hops")).checkpoint()
    front, k = seen, 1
    while not front.isEmpty():
        k += 1
        ahead = front.select("u", F.col("v").alias("a")).join(step, "a").select("u", F.col("b").alias("v")).where("u <> v").distinct()
        front = ahead.join(seen.select("u", "v"), ["u", "v"], "left_anti").withColumn("hops", F.lit(k)).checkpoint()
        seen = seen.unionByName(front)
    size = n.agg(F.count(F.lit(1)).alias("__n"))
    most = seen.agg(F.max("hops").alias("__most")).crossJoin(size).select(F.coalesce(F.col("__most") + 1, F.col("__n")).alias("__far"))
    every = n.withColumnRenamed("node", "source").crossJoin(n.withColumnRenamed("node", "target")).crossJoin(F.broadcast(most))  # the result has all pairs
    rows = every.join(seen.select(F.col("u").alias("source"), F.col("v").alias("target"), "hops"), ["source", "target"], "left")
    hops = F.when(F.col("source") == F.col("target"), 0).otherwise(F.coalesce("hops", "__far"))
    return rows.select("source", "target", hops.cast("double").alias("hops"))
