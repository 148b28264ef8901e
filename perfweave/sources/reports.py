"""Published result tables: read as text, resolve columns by name, clean
(S3, P3, P4, X26, A14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column roles of a per-model report: (role, match kind, fragment).
MODEL_REPORT_SPEC = (("model", "exact", "model"), ("batch", "contains", "batch"),
                     ("actual", "contains", "actual"), ("pred", "contains", "pred"))
ERROR_FRAGMENT = "error"

# Column roles of an unseen-GPU report: the caller names the fragments of the
# two predictors' columns.
def unseen_report_spec(full: str = "full", base: str = "base"):
    return (("gpu", "contains", "gpu"), ("full", "contains", full), ("base", "contains", base))



def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, header names stripped of blanks."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return strip_header(df)


def strip_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def resolve_columns(df: DataFrame, spec=MODEL_REPORT_SPEC) -> dict:
    """First column per role: exact (case-insensitive) or substring match."""
    out = {}
    for role, kind, frag in spec:
        hits = [c for c in df.columns
                if (c.lower() == frag if kind == "exact" else frag in c.lower())]
        if not hits:
            raise ValueError(f"no column for {role!r} in {df.columns}")
        out[role] = hits[0]
    err = [c for c in df.columns if ERROR_FRAGMENT in c.lower()]
    out["error"] = err[0] if err else None
    return out


def to_num(c) -> Column:
    """Keep only digits, '.', '-', 'e', 'E'; unparsable -> NULL."""
    s = F.regexp_replace(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"),
                         r"[^0-9.\-eE]", "")
    return s.try_cast("double")


def abs_pct_error(pred: Column, actual: Column) -> Column:
    """100 |pred - actual| / actual; actual 0 -> missing."""
    return F.try_divide(100.0 * F.abs(pred - actual), F.nullif(actual, F.lit(0.0)))


def clean_model_report(df: DataFrame) -> DataFrame:
    """(Model, Batch, Actual, Predicted, Error) with numeric values, rows
    missing any of the first four dropped (P4), sorted by model and batch."""
    cols = resolve_columns(df)
    out = df.select(F.col(cols["model"]).alias("Model"), to_num(cols["batch"]).alias("Batch"),
                    to_num(cols["actual"]).alias("Actual"), to_num(cols["pred"]).alias("Predicted"),
                    *( [to_num(cols["error"]).alias("Error")] if cols["error"] else []))
    if cols["error"] is None:
        out = out.withColumn("Error", abs_pct_error(F.col("Predicted"), F.col("Actual")))
    return out.dropna(subset=["Model", "Batch", "Actual", "Predicted"]).orderBy("Model", "Batch")


def clean_unseen_report(df: DataFrame, full: str = "full", base: str = "base") -> DataFrame:
    """(GPU, RMSE_full_ms, RMSE_base_ms) of a two-predictor report: columns by
    name, numbers cleaned (P3), incomplete rows dropped (P4), sorted by GPU."""
    cols = resolve_columns(df, unseen_report_spec(full, base))
    out = df.select(F.col(cols["gpu"]).alias("GPU"), to_num(cols["full"]).alias("RMSE_full_ms"),
                    to_num(cols["base"]).alias("RMSE_base_ms"))
    return out.dropna().orderBy("GPU")


def report_ymax(df: DataFrame, a: str = "Actual", b: str = "Predicted") -> DataFrame:
    """Axis limit: largest value of two columns."""
    return df.agg(F.max(F.greatest(a, b)).alias("ymax"))
