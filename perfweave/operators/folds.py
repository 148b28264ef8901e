"""Deterministic fold assignment (M2).

A random permutation is not reproducible across engines or partitionings; a
keyed hash is.  ``assign_folds`` takes the hash itself modulo k: a narrow
projection whose folds have about equal sizes.  ``even_folds`` takes the rank
of the hash modulo k, a shuffled split whose sizes differ by at most one row:
the hashes are cut into ranges, and a row's rank is the size of the ranges
before its own plus its place there, so no task ranks the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def hash_fold(key_cols, k: int = 5, seed: int = 42) -> Column:
    """``conv(substr(md5('seed|k1|k2..'), 1, 8), 16, 10) % k``."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def assign_folds(df: DataFrame, key_cols, k: int = 5, seed: int = 42,
                 out: str = "fold") -> DataFrame:
    return df.withColumn(out, hash_fold(key_cols, k, seed))


def even_folds(df: DataFrame, key_cols, k: int = 5, seed: int = 42, out: str = "fold", ties=()) -> DataFrame:
    """Folds 0 .. k-1 by the rank of the rows' md5 (ties: by the keys, then by the columns ``ties``)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    order = ["__h", *key_cols, *ties]
    ranged = written(df.withColumn("__h", F.md5(key)).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__part", "__start")  # a row a range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    ranked = ranged.withColumn("__place", place).join(written(starts, "starts"), "__part")
    return ranked.withColumn(out, F.pmod(F.col("__start") + F.col("__place") - 1, F.lit(k)).cast("bigint")).drop("__h", "__part", "__place", "__start")
