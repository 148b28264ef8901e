"""Trial fact table: read, validate, derive, union, write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TARGET_BASE, TARGET_FULL
from ..functions.estimators import arithmetic_intensity, memory_estimate, step_time_columns
from ..functions.nulls import canon_missing, col_, dbl
from . import fixtures
from .csv_files import read_csv

REQUIRED_COLUMNS = ("gpu_name", "batch_size", "model", TARGET_FULL, TARGET_BASE, "vcpu", "storage")

# Trial columns of the generators (fixed values: names of their CSV files).
TRIAL_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("architecture", T.StringType()), T.StructField("optimizer", T.StringType()),
    T.StructField("gpu_name", T.StringType()), T.StructField("storage", T.StringType()),
    T.StructField("bottleneck", T.StringType()),
    T.StructField("dataset_size", T.LongType()), T.StructField("batch_size", T.LongType()),
    T.StructField("prec_bits", T.LongType()), T.StructField("depth", T.LongType()),
    T.StructField("vcpu", T.LongType()), T.StructField("learning_rate", T.DoubleType()),
    T.StructField("amp", T.BooleanType()),
    T.StructField("param_count", T.LongType()), T.StructField("param_bytes", T.LongType()),
    T.StructField("optimizer_state_bytes", T.LongType()),
    T.StructField("master_param_bytes", T.LongType()),
    T.StructField("total_state_bytes", T.LongType()),
    T.StructField("flops_fwd_per_sample", T.DoubleType()),
    T.StructField("flops_train_per_sample", T.DoubleType()),
    T.StructField("flops_train_per_batch", T.DoubleType()),
    T.StructField("act_bytes_per_sample_proxy", T.LongType()),
    T.StructField("arithmetic_intensity_train", T.DoubleType()),
    T.StructField("avg_batch_time_ms", T.DoubleType()), T.StructField("p90_batch_time_ms", T.DoubleType()),
    T.StructField("T_gpu_ms", T.DoubleType()), T.StructField("T_cpu_io_ms", T.DoubleType()),
    T.StructField("T_step_ms", T.DoubleType()), T.StructField("loader_ratio", T.DoubleType()),
    T.StructField("input_shape", T.StringType()), T.StructField("num_classes", T.LongType()),
    T.StructField("precision", T.LongType()),
    T.StructField("flops_1x1_frac", T.DoubleType()), T.StructField("flops_3x3_frac", T.DoubleType()),
    T.StructField("flops_depthwise_frac", T.DoubleType()), T.StructField("flops_grouped_frac", T.DoubleType()),
    T.StructField("bn_layers", T.LongType()), T.StructField("act_layers", T.LongType()),
    T.StructField("sum_hwC", T.LongType()), T.StructField("max_hwC", T.LongType()),
    T.StructField("disk_bytes_per_sample", T.DoubleType()),
])


def require_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Plan-time check (S2): raise listing every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def scan_trials(spark: SparkSession, path: str, fmt: str = "parquet",
                schema: T.StructType | None = None) -> DataFrame:
    """Read a trial table (S1).  CSV columns are taken by name and get the
    schema's types (no inference pass over the data; lines that do not fit are
    left out, see ``csv_files.read_csv`` for their quarantine); Parquet
    directories merge per-GPU schemas."""
    if fmt == "csv":
        return read_csv(spark, path, schema or TRIAL_SCHEMA)[0]
    return spark.read.option("mergeSchema", True).parquet(path)


def drop_missing_targets(df: DataFrame, targets=(TARGET_FULL, TARGET_BASE)) -> DataFrame:
    """Drop rows missing either target (P1): NULL and NaN both count as missing."""
    return df.dropna(subset=list(targets))


def derive_trial_columns(df: DataFrame) -> DataFrame:
    """Generator-side derived columns of an image-family trial."""
    B = dbl("batch_size")
    df = df.withColumn("amp", F.col("prec_bits") == 16)
    df = memory_estimate(df)
    df = df.withColumns({
        "flops_train_per_sample": dbl("flops_fwd_per_sample") * 3.0,
        "flops_train_per_batch": dbl("flops_fwd_per_sample") * 3.0 * B,
    })
    df = df.withColumn("arithmetic_intensity_train", arithmetic_intensity(
        "flops_train_per_sample", "param_bytes", "act_bytes_per_sample_proxy"))
    return df.withColumns(step_time_columns())


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture trial table with all generator columns; missing values are
    canonicalised everywhere but in the two targets (P2)."""
    return canonical_trials(derive_trial_columns(fixtures.raw_trials(spark, sf_dir)))


def canonical_trials(df: DataFrame) -> DataFrame:
    return canon_missing(df, skip=(TARGET_FULL, TARGET_BASE))


def union_trials(frames) -> DataFrame:
    """Union per-GPU trial tables whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def slug(c) -> Column:
    """File-name-safe form (S5): reserved/control characters -> '_', trim,
    whitespace runs -> '_', at most 140 characters."""
    s = F.regexp_replace(col_(c).cast("string"), r'[<>:"/\\|?*\x00-\x1F]', "_")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"\s+", "_")
    return F.substring(s, 1, 140)


def dedup_columns(df: DataFrame) -> DataFrame:
    """Keep the first of each duplicated column name (P5)."""
    seen, keep = set(), []
    tmp = [f"__c{i}" for i in range(len(df.columns))]
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(F.col(tmp[i]).alias(c))
    return df.toDF(*tmp).select(*keep)


def order_columns(df: DataFrame, last: str | None = None) -> DataFrame:
    """Column order for writing; optionally move one column last."""
    cols = [c for c in df.columns if c != last] + ([last] if last in df.columns else [])
    return df.select(*cols)


def write_trials(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write one folder per (architecture, GPU) (S4).  The partition columns
    make a held-out GPU a partition filter for readers."""
    # Rows of one folder come together; large folders are split by size at run time.
    out = dedup_columns(df).withColumn("gpu_slug", slug("gpu_name")).hint("rebalance", "architecture", "gpu_slug")
    w = out.write.mode(mode).partitionBy("architecture", "gpu_slug")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
