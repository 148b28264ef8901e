"""Driver tables: one parquet file per table under an ``sf`` folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# Fact tables whose per-row work (features, tokenisation) is CPU-heavy.
FACT_TABLES = ("lineitem", "events", "documents", "pages", "conversations", "orders")


SPREAD_BYTES = 128 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a table that is a single file of at most SPREAD_BYTES.

    Such a file may be one row group, so one split, and every narrow stage
    over it one task.  What is shuffled for it is bounded by SPREAD_BYTES;
    larger tables are read as Spark splits them.  Rows are the same either way.
    """
    if len(df.inputFiles()) > 1 or int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_small(df) if name in FACT_TABLES else df
