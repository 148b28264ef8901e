"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.storage import written  # noqa: F401  (operators import it from here)

# A word is a run of characters other than these (Java and Python syntax agree).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def code_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (a path all machines see; elsewhere the package goes with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain scan of a whole input table; Spark's splits decide the parallelism."""
    code_on_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array (null or blank text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` sees it as a variable,
    so the optimizer cannot copy a costly expression into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dense_buckets(df: DataFrame, rows_per_bucket: int, least: int | None = None) -> int:
    """Number of key buckets so that one bucket holds about ``rows_per_bucket`` rows."""
    spark = df.sparkSession
    floor = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, -(-df.count() // rows_per_bucket))
