"""Scalar expressions: missing-value semantics and name rules."""

import math

import pytest
from pyspark.sql import functions as F

from perfweave.functions import hardware as hw
from perfweave.functions import nulls
from perfweave.functions.estimators import step_time_columns, storage_label, transformer_block_flops


def _one(spark, expr, schema="x double", rows=None):
    df = spark.createDataFrame(rows or [(None,)], schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_guarded_max_keeps_missing(spark):
    # greatest() alone would return 1e-9 for a NULL input
    assert _one(spark, nulls.guarded_max(1e-9, "x")) == [None]
    assert _one(spark, nulls.guarded_max(1e-9, "x"), rows=[(-5.0,)]) == [1e-9]


def test_safe_ratio(spark):
    rows = [(10.0, 2.0), (10.0, None), (None, 2.0), (10.0, 0.0)]
    out = _one(spark, nulls.safe_ratio("a", "b"), "a double, b double", rows)
    assert out[0] == 5.0 and out[1] is None and out[2] is None
    assert out[3] == pytest.approx(10.0 / 1e-9)


def test_clip01(spark):
    rows = [(None,), (-1.0,), (0.5,), (3.0,)]
    assert _one(spark, nulls.clip01("x"), rows=rows) == [None, 0.0, 0.5, 1.0]


def test_canon_missing_turns_nan_and_inf_into_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "x double")
    out = [r[0] for r in nulls.canon_missing(df).collect()]
    assert out == [None, None, None, 2.0]


def test_nan_compares_true_in_spark_so_canonicalise_first(spark):
    # the reason for canon_missing: NaN > 0.9 is true in Spark, false in numpy
    df = spark.createDataFrame([(float("nan"),)], "x double")
    assert df.select((F.col("x") > 0.9).alias("v")).first()[0] is True
    assert nulls.canon_missing(df).select((F.col("x") > 0.9).alias("v")).first()[0] is None


def test_truthy(spark):
    rows = [("True",), ("1",), ("yes",), ("no",), (None,), ("false",)]
    assert _one(spark, nulls.is_truthy("x"), "x string", rows) == [1, 1, 1, 0, 0, 0]


def test_category_and_contains(spark):
    rows = [("NVIDIA A100",), (None,)]
    assert _one(spark, nulls.as_category("x"), "x string", rows) == ["NVIDIA A100", "nan"]
    assert _one(spark, nulls.contains_any("x", ["a100"]), "x string", rows) == [True, False]


@pytest.mark.parametrize("name,family", [
    ("NVIDIA H100 PCIe", "Hopper"), ("NVIDIA L4", "Ada"), ("NVIDIA L40S", "Ada"),
    ("NVIDIA GeForce RTX 5090", "Ada"), ("NVIDIA RTX 4000 Ada Generation", "Ada"),
    ("Quadro RTX 4000", "Ada"), ("NVIDIA A100 80GB PCIe", "Ampere"), ("NVIDIA A40", "Ampere"),
    ("NVIDIA RTX A4000", "Ampere"),   # "A40" matches first
    ("Tesla V100-SXM2-32GB", "Turing"), ("Tesla T4", "Turing"), ("Tesla P100", "Pascal"),
    ("Tesla P40", "Pascal"), ("Mystery GPU", "Unknown"), (None, "Unknown")])
def test_arch_family(spark, name, family):
    assert _one(spark, hw.arch_family("x"), "x string", [(name,)]) == [family]


def test_flags(spark):
    rows = [("NVIDIA A100 80GB PCIe",), ("Tesla V100-SXM2-32GB",), (None,)]
    assert _one(spark, hw.is_pcie("x"), "x string", rows) == [1, 0, 0]
    assert _one(spark, hw.is_sxm("x"), "x string", rows) == [0, 1, 0]
    assert _one(spark, hw.has_tensor_cores("x"), "x string", rows) == [1, 1, 0]
    assert _one(spark, hw.is_datacenter("x"), "x string", rows) == [1, 1, 0]


def test_step_time_columns(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 1.0), (None, 1.0), (2.0, None)], "g double, h double")
    cols = step_time_columns("g", "h")
    out = df.select(*[c.alias(k) for k, c in cols.items()]).collect()
    assert [r["bottleneck"] for r in out] == ["gpu", "host", "host", "host"]
    assert [r["T_step_ms"] for r in out] == [3.0, 1.0, None, 2.0]
    assert out[0]["loader_ratio"] == 0.25 and out[2]["loader_ratio"] is None


def test_storage_label(spark):
    rows = [(None,), ("nvme",), ("SSD",), ("hdd",)]
    assert _one(spark, storage_label("x"), "x string", rows) == ["NVME", "NVME", "SSD", "SSD"]


def test_transformer_block_flops(spark):
    df = spark.createDataFrame([(128, 256, 8, 1024)], "s int, d int, h int, f int")
    v = df.select(transformer_block_flops("s", "d", "h", "f")).first()[0]
    d_head = 256 // 8
    assert v == 4 * 256 * 256 + 2 * 128 * 256 * d_head + 2 * 256 * 1024
    assert math.isfinite(v)
