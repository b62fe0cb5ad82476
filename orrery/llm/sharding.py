"""Sharding by extendible hashing.

A directory is indexed by the first bits of a key's hash. A bucket whose rows exceed the byte limit
is split on one more bit, and only such a bucket, until every shard fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import broadcast_if, stored

LIMIT = 64 << 20
#: Bits of the hash that can be used; 52 of MD5, so that every engine can hold it in a long.
HASH_BITS = 52
#: Bits that a pass adds at most: the first, and each of the others.
FIRST, STEP = 18, 9
#: So many leaves of one depth are broadcast at most (some 80 MB); more are joined by shuffle.
BROADCAST_LEAVES = 1 << 21


def key_hash(c: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """From rows (h, n_bytes) the directory (depth, prefix, shard_bytes, whole), a stored table of a row a shard:
    the shard of all rows whose hash's first `depth` bits are `prefix`. whole is false for a bucket of
    one hash that exceeds the limit by itself. The first pass looks at as many
    bits as the total calls for, each other at STEP more bits of the buckets that are still too
    large, and of their rows alone. A bucket is a leaf if it fits and the one that it was split from
    doesn't. The driver holds no more than the number of passes.
    """
    # one sum for each hash, so that rows of one key are one row from here on
    rows = stored(rows.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes")), "hash-sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    found, above, at = None, 0, rows
    bits = min(FIRST, max(0, math.ceil(math.log2(max(1, total) / limit)) + 4))
    while True:
        width = above + bits
        cells = stored(at.groupBy(F.shiftright("h", HASH_BITS - width).alias("cell")).agg(F.sum("n_bytes").alias("n")), "cells")
        depths = F.explode(F.sequence(F.lit(above), F.lit(width))).alias("depth")
        shift = F.lit(width) - F.col("depth")
        sums = cells.select("cell", "n", depths).groupBy("depth", F.call_function("shiftright", F.col("cell"), shift).alias("prefix")).agg(F.sum("n").alias("n"))
        sums = stored(sums, "buckets")
        split = sums.where(F.col("n") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("from"))
        child = sums.where((F.col("n") <= limit) | ((F.col("depth") == width) & F.lit(width == HASH_BITS)))
        child = child.withColumn("from", F.shiftright("prefix", 1))
        leaves = child.join(split, ["depth", "from"], "left_semi")
        if above == 0:  # the bucket of all rows was split from none
            leaves = leaves.unionByName(sums.where(F.col("depth") == 0).where(F.col("n") <= limit).withColumn("from", F.lit(0).cast("long")))
        part = leaves.select("depth", "prefix", F.col("n").alias("shard_bytes"), (F.col("n") <= limit).alias("whole"))
        found = part if found is None else found.unionByName(part)
        large = sums.where((F.col("depth") == width) & (F.col("n") > limit)).select(F.col("prefix").alias("top"))
        if width == HASH_BITS or (n := large.count()) == 0:
            return stored(found, "directory")
        top = F.shiftright("h", HASH_BITS - width)
        at = rows.join(broadcast_if(large, n, BROADCAST_LEAVES), top == F.col("top"), "left_semi")
        above, bits = width, min(STEP, HASH_BITS - width)


def shard(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with shard (the hash's first bits as text of 0 and 1, '' for the only one), shard_bytes and
    fits.

    A row weighs its text's bytes; a null text weighs nothing, a null key hashes like ''. Rows of one
    key share a shard; only where they alone exceed the limit does a shard not fit, and fits is then
    false. Input columns of these names are replaced; an empty table gives an empty table.
    """
    docs = docs.drop("shard", "shard_bytes", "fits")
    names = docs.columns
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    found = directory(docs.select(key_hash(F.col(key_col)).alias("h"), size.alias("n_bytes")), limit)
    sizes = {r["depth"]: r["count"] for r in found.groupBy("depth").count().collect()}  # a row a depth, 53 at most
    out = docs.withColumn("__h", key_hash(F.col(key_col)))
    for d, n in sorted(sizes.items()):  # three or four, as hashes are even
        leaves = found.where(F.col("depth") == d).select(F.col("prefix").alias(f"__prefix{d}"), F.col("shard_bytes").alias(f"__bytes{d}"), F.col("whole").alias(f"__whole{d}"))
        out = out.join(broadcast_if(leaves, n, BROADCAST_LEAVES), F.shiftright("__h", HASH_BITS - d) == F.col(f"__prefix{d}"), "left")
    pick = lambda what: F.coalesce(*[F.col(f"__{what}{d}") for d in sizes]) if sizes else F.lit(None)
    depth = F.coalesce(*[F.when(F.col(f"__prefix{d}").isNotNull(), d) for d in sizes]) if sizes else F.lit(0)
    bits = F.lpad(F.bin("__h"), HASH_BITS, "0")
    return out.select(*names, F.substr(bits, F.lit(1), depth).alias("shard"), pick("bytes").alias("shard_bytes"), pick("whole").alias("fits"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Each shard as a folder of its own; a task writes one shard, which fits the limit."""
    named = sharded.withColumn("shard", F.concat(F.lit("b"), "shard"))
    named.repartition("shard").write.partitionBy("shard").parquet(path)
