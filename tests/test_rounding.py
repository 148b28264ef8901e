"""The comparison form rounds like Spark's decimal rounding, without its decimals for ordinary values."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_rounded_equals_decimal_rounding(spark):
    rng = np.random.default_rng(3)
    odd = [0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e4, -1e4, 9999.9999999, 5e-7, -5e-7, 4.9e-324, 0.0015, 2.5, 1e300, None]
    ties = [*(rng.integers(-10**10, 10**10, 2000) / 1e6 + 5e-7), *(rng.integers(-10**8, 10**8, 2000) / 1e4 + 5e-5)]
    values = [*odd, *map(float, ties), *map(float, rng.uniform(-1e4, 1e4, 2000)), *map(float, np.exp(rng.normal(-8, 6, 2000)))]
    df = spark.createDataFrame([(v, v) for v in values], "x double, f float")
    assert entry.rounded(df).schema == df.schema
    for digits in (4, 6):
        for c in ("x", "f"):
            plain = F.when(F.abs(c) < 1e4, F.round(c, digits)).otherwise(F.col(c)).cast("string")
            both = df.select(plain.alias("a"), entry._round(F.col(c), digits, c == "x").cast("string").alias("b"))
            assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_ordinary_values_are_rounded_without_decimals(spark):
    assert "FLOOR" in str(entry._round(F.col("x"), 6)).upper()
