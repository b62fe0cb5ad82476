"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so; its recipe is the ordered list of its chunks' identifiers.
Recipes, not texts, are compared and moved. Identifiers are verified: the chunks of texts whose
recipes agree are brought together once, each distinct chunk once a task, and where two chunks share
a hash each gets an identifier of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._work import broadcast_if, join_counted, stored

#: A chunk ends, once it has 256 characters, behind an e and a space or line end, behind a punctuation
#: mark beyond ASCII, or in a run of 64 characters without white space behind one of a few frequent
#: ones; at 4,096 at the latest, and the last one may be shorter.
CHUNK = r"(?s).{256,4096}?(?:(?<=e)[ \n]|[\p{P}&&[^\x00-\x7F]]|(?<=\S{64})[eAQ07\u0435\u0627\u306E\u7684\uC774]|\z)|.{4096}|.+"
#: So many ids of texts with copies are broadcast at most (8 MB); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: So many longs, in the recipes of all groups together, are broadcast at most (16 MB).
BROADCAST_LONGS = 2_000_000


def chunks(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, recipe, digest, text_sha256) of every row; recipe: a list of 64-bit hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).alias("n_bytes"),
        F.transform(chunks(text_col), lambda c: F.xxhash64(c)).alias("recipe"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
    )
    return rows.withColumn("digest", F.xxhash64("recipe"))


def _clashes(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h, chunk, rank): the chunks of shared texts whose hash another chunk has too, numbered."""
    ids = shared.select(F.col("doc_id").alias("__id")).distinct()
    ids = broadcast_if(ids, ids.count(), BROADCAST_IDS)
    texts = docs.join(ids, docs[id_col].eqNullSafe(F.col("__id")), "left_semi")
    pieces = texts.select(F.explode(chunks(text_col)).alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")
    distinct = pieces.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n > 1").withColumn(
        "rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
    ).select("h", "chunk", "rank")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    Texts are equal if they are identical, null counting as empty. keep_id is the largest id of the
    group; a row stays (kept) if it has that id, so rows that repeat both stay, and a group whose
    ids are all null stays whole. Columns other than id and text are not read; an empty table gives
    an empty table.
    """
    made = stored(recipes(docs, id_col=id_col, text_col=text_col), "recipes")
    keys = made.groupBy("n_bytes", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    keys = stored(keys, "shared-digests")
    shared = made.join(broadcast_if(keys, keys.count(), BROADCAST_IDS), ["n_bytes", "digest"], "left_semi")
    clashes = stored(_clashes(docs, shared.select("doc_id"), id_col, text_col), "clashes")
    if not clashes.isEmpty():
        made = stored(_renumbered(docs, made, clashes, id_col, text_col), "recipes")
        shared = made
    groups = shared.groupBy("n_bytes", "digest", "recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = stored(groups, "copy-groups")
    extent = groups.agg(F.sum(F.size("recipe") + 4)).first()[0] or 0  # longs of all recipes and row heads
    by = ["n_bytes", "digest", "recipe"]
    if extent <= BROADCAST_LONGS:
        joined = made.join(F.broadcast(groups), by, "left")
    else:
        joined = join_counted(made, groups.withColumn("rows", F.col("size")), by, "rows")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _renumbered(docs: DataFrame, made: DataFrame, clashes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The recipes with clashing hashes followed by their chunk's number among those that share it."""
    hit = F.broadcast(clashes.select("h").distinct()) if clashes.count() <= BROADCAST_IDS else clashes.select("h").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha"), chunks(text_col).alias("c"))
    places = rows.select("doc_id", "n_bytes", "sha", F.posexplode("c").alias("pos", "chunk")).withColumn("h", F.xxhash64("chunk"))
    places = places.join(hit, "h", "left_semi").join(clashes, ["h", "chunk"]).groupBy("doc_id", "n_bytes", "sha").agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("pos", "rank")))).alias("ranks")
    )
    both = made.alias("m").join(
        places.alias("p"),
        F.col("m.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("m.n_bytes") == F.col("p.n_bytes")) & (F.col("m.sha") == F.col("p.sha")),
        "left",
    )
    ranks = F.transform("m.recipe", lambda h, i: F.coalesce(F.element_at("p.ranks", i), F.lit(0)).cast("long"))
    return both.select(
        "m.doc_id", "m.n_bytes", F.when(F.col("p.ranks").isNull(), F.col("m.recipe")).otherwise(F.concat("m.recipe", ranks)).alias("recipe"),
        "m.sha", F.when(F.col("p.ranks").isNull(), F.col("m.digest")).otherwise(F.xxhash64("m.recipe", ranks)).alias("digest"),
    )
