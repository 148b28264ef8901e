"""Column profile in one pass: heavy-tail detection and log1p columns.

For every candidate column the aggregate computes the facts the decision
needs (any negative, values outside {0, 1}, missing count, bias-adjusted
skew); the decision itself is data-dependent schema, so the single profile
row is read on the driver and turned into ``log1p__<col>`` projections.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import dbl, numeric_columns
from .columns import arrays, column_moments, names_of


def skew_candidates(df: DataFrame, target: str, leaky=(), extra_drop=()) -> list[str]:
    drop = set(leaky) | set(extra_drop) | {target}
    return [c for c in numeric_columns(df) if c not in drop]


def bias_adjusted_skew(c) -> F.Column:
    """Sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2); missing for n < 3."""
    x = dbl(c)
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (column, n, n_missing, n_non01, has_negative, skew, take_log).

    One pass over the rows for all columns and statistics (``column_moments``);
    what is merged is one row per column and task.
    """
    if not columns:
        raise ValueError("no columns to profile")
    m = column_moments(arrays(df, F.lit(0), columns), len(columns))
    n, q, t = F.col("n"), F.col("q"), F.col("t")
    g1 = F.when((n >= 3) & (q > 0), F.sqrt(n) * t / (q * F.sqrt(q)) * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    prof = m.select(names_of(columns).alias("column"), n.cast("bigint").alias("n"), (F.col("rows") - n.cast("bigint")).alias("n_missing"),
                    F.col("non01").alias("n_non01"), (F.col("negative") > 0).alias("has_negative"), g1.alias("skew"))
    prof = prof.withColumn("skew", F.when(~F.isnan("skew"), F.col("skew")))
    binary = (F.col("n_non01") == 0) & (F.col("n_missing") == 0)
    take = (~F.col("has_negative")) & (~binary) & F.coalesce(F.col("skew") > 1.0, F.lit(False))
    return prof.withColumn("take_log", take)


def heavy_tail_columns(df: DataFrame, target: str, leaky=(), extra_drop=()) -> list[str]:
    """Columns that get a log1p twin; one job, one small collect (k rows)."""
    cols = skew_candidates(df, target, leaky, extra_drop)
    prof = profile(df, cols).collect()
    chosen = {r["column"] for r in prof
              if r["take_log"] and r["skew"] is not None and math.isfinite(r["skew"])}
    return [c for c in cols if c in chosen]


def with_log1p(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"log1p__{c}": F.log1p(dbl(c)) for c in cols}) if cols else df


def auto_log1p(df: DataFrame, target: str, leaky=(), extra_drop=()) -> tuple[DataFrame, list[str]]:
    cols = heavy_tail_columns(df, target, leaky, extra_drop)
    return with_log1p(df, cols), [f"log1p__{c}" for c in cols]
