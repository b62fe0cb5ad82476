"""Resampling that every engine repeats alike: rows are ordered by MD5 of id, replicate and salt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key(*parts: Column | str, salt: str) -> Column:
    return F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(salt)))


def number(*parts: Column | str, salt: str) -> Column:
    """A long of 52 bits."""
    return F.conv(F.substring(key(*parts, salt=salt), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str, salt: str) -> Column:
    return number(*parts, salt=salt) / F.lit(float(2**52))


def coin(*parts: Column | str, salt: str) -> Column:
    """1 or -1."""
    return F.when(number(*parts, salt=salt) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def replicates(df: DataFrame, n: int, column: str = "perm_idx") -> DataFrame:
    """Each row once for every replicate number. Spark takes an explode to be as large as its input, so that a join would
    broadcast a small table's replicates, however many, through the driver: they ask for a merge join."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("merge")


def permuted(df: DataFrame, values: Sequence[str], row: str, salt: str, strata: Sequence[str] = (), replicate: str | None = None) -> DataFrame:
    """df with each of values permuted inside the strata (and replicate) as <value>_perm; all values of
    a row move together. Places are numbered by id, movers by hash; a row's place and its values' new place follow each other
    in one order of both, so that rows are dealt out once and never joined. Rows without a stratum are left out."""
    by = [*strata, *([replicate] if replicate else [])]
    parts = [row, *([replicate] if replicate else [])]
    place = Window.partitionBy(*by).orderBy(row)
    mover = Window.partitionBy(*by).orderBy(key(*parts, salt=salt), row)
    rest = [c for c in df.columns if c not in by]
    known = df.dropna(subset=by) if by else df
    numbered = known.withColumn("__at", F.row_number().over(place)).withColumn("__to", F.row_number().over(mover))
    own, moved = F.struct(*rest), F.struct(*[F.col(v).alias(f"{v}_perm") for v in values])
    none = lambda s: F.when(F.lit(False), s)
    here = F.struct(F.col("__at").alias("at"), F.lit(1).alias("kind"), own.alias("own"), none(moved).alias("moved"))
    there = F.struct(F.col("__to").alias("at"), F.lit(0).alias("kind"), none(own).alias("own"), moved.alias("moved"))
    both = numbered.select(*by, F.explode(F.array(here, there)).alias("__e"))
    last = F.lag("__e.moved").over(Window.partitionBy(*by).orderBy("__e.at", "__e.kind"))
    return both.withColumn("__v", last).where("__e.kind = 1").select(*by, "__e.own.*", "__v.*")


def resampled(df: DataFrame, values: Sequence[str], row: str, salt: str, strata: Sequence[str] = (), replicate: str | None = None) -> DataFrame:
    """df with values drawn with replacement inside the strata as <value>_boot."""
    by = [*strata, *([replicate] if replicate else [])]
    parts = [row, *([replicate] if replicate else [])]
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    left = df.withColumn("__at", number(*parts, salt=salt) % n + 1)
    right = df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(row)).alias("__at"), *[F.col(v).alias(f"{v}_boot") for v in values])
    return left.join(right, [*by, "__at"]).drop("__at")


def sample(df: DataFrame, n: int, row: str, salt: str, strata: Sequence[str] = ()) -> DataFrame:
    """n rows without replacement, of each stratum if there are strata."""
    if not strata:
        return df.orderBy(key(row, salt=salt), row).limit(n)
    w = Window.partitionBy(*strata).orderBy(key(row, salt=salt), row)
    return df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= n).drop("__at")


def stratified_sample(df: DataFrame, n: int, row: str, salt: str, label: str = "label") -> DataFrame:
    """At most about n rows, classes in their shares: each keeps max(1, round(n * share)) rows. No class
    keeps more than n, so tasks cut their own rows to n a class before any are moved."""
    own = Window.partitionBy(label).orderBy(key(row, salt=salt), row)
    first = df.withColumn("__at", F.row_number().over(own)).where(F.col("__at") <= n)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    total = sizes.agg(F.sum("__size").alias("__total"))
    quota = F.when(F.col("__total") <= n, F.col("__size")).otherwise(F.greatest(F.lit(1), F.round(n * F.col("__size") / F.col("__total"))))
    sizes = sizes.crossJoin(F.broadcast(total)).select(F.col(label).alias("__label"), quota.alias("__quota"))  # one row
    kept = first.join(sizes, F.col(label).eqNullSafe(F.col("__label"))).where(F.col("__at") <= F.col("__quota"))
    return kept.select(*df.columns)


def folds(df: DataFrame, k: int, row: str, label: str, salt: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with a stratified fold number from 0 to k - 1."""
    w = Window.partitionBy(*keys, label).orderBy(key(row, salt=salt), row)
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)
