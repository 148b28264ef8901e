"""End-to-end evaluation plans: trials -> features -> out-of-sample
predictions -> reports (K-fold and leave-one-GPU-out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CNN, KFOLD_SEED, KFOLD_SPLITS, MIN_HELDOUT_ROWS, TARGET_BASE, TARGET_FULL, FamilyConfig
from ..functions.nulls import dbl
from ..operators import predict
from ..operators.folds import even_folds
from ..operators.features import engineer_with_dimension
from ..operators.joins import enrich_with_spec
from ..operators.matrix import base_features, feature_columns
from ..operators.profile import auto_log1p
from ..session import jit_sized_methods
from ..sources import fixtures
from ..sources.trials import canonical_trials, derive_trial_columns, drop_missing_targets, require_columns, trials
from ..storage import written
from . import reports

# Fixture row keys: identifiers of the adapter view, never features.
KEY_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "fold")

# Group keys of the exact group-mean predictors: the full model sees host
# configuration, the GPU-only baseline does not.
FULL_GROUPS = ("model", "vcpu", "storage", "batch_size")
BASE_GROUPS = ("model", "batch_size")


def evaluation_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture trials with both targets present, joined to the GPU spec."""
    jit_sized_methods(spark)
    t = drop_missing_targets(require_columns(trials(spark, sf_dir)))
    return enrich_with_spec(t, fixtures.gpu_spec(spark))


def evaluation_features(spark: SparkSession, sf_dir: str, fam: FamilyConfig = CNN, log1p: bool = True) -> DataFrame:
    """Fixture trials -> full feature frame, GPU-only features via the GPU
    dimension (see ``engineer_with_dimension``).

    The projection is a narrow, codegen'd pipeline over the joined trials, so
    consumers recompute it: at sf0.1 persisting the ~100-column frame cost
    more than the recomputations it saves.
    """
    jit_sized_methods(spark)
    raw = drop_missing_targets(fixtures.raw_trials(spark, sf_dir))
    # Statistics, profile, fold passes and the result all read these rows.  A join that shuffles
    # them runs once; where one side is broadcast, joining again is cheaper than writing.
    if "BroadcastHashJoin" not in raw._jdf.queryExecution().executedPlan().toString():
        raw = written(raw, "trials")
    t = require_columns(canonical_trials(derive_trial_columns(raw)))
    f = engineer_with_dimension(t, fixtures.gpu_spec(spark), fam)
    return auto_log1p(f, TARGET_FULL, fam.leaky, extra_drop=KEY_COLS)[0] if log1p else f


def model_features(f: DataFrame, fam: FamilyConfig = CNN) -> tuple[list[str], list[str]]:
    full = feature_columns(f, fam, TARGET_FULL, extra_exclude=KEY_COLS)
    return full, base_features(fam, full)


def kfold_predictions(df: DataFrame, fold_col: str = "fold", predictor: str = "linear",
                      x: str = "log2_batch_size", min_rows: int | None = None) -> DataFrame:
    """Out-of-fold predictions of both models (M3 with exact M6 predictors).

    ``min_rows`` restricts the output to held-out folds with enough rows
    (leave-one-GPU-out)."""
    if predictor == "mean":
        return predict.oof_group_mean(df, fold_col, [("pred_full", TARGET_FULL, FULL_GROUPS),
                                                     ("pred_base", TARGET_BASE, BASE_GROUPS)], min_rows)
    if predictor == "linear":
        return predict.oof_linear(df, fold_col, [("pred_full", x, TARGET_FULL),
                                                 ("pred_base", x, TARGET_BASE)], min_rows)
    raise ValueError(f"unknown predictor {predictor!r}")


def with_batch_features(df: DataFrame) -> DataFrame:
    return df.withColumn("log2_batch_size", F.log2(F.greatest(F.lit(1.0), dbl("batch_size"))))


def kfold_report(spark: SparkSession, sf_dir: str, predictor: str = "linear",
                 keys=("model", "vcpu", "storage"), even: bool = False) -> DataFrame:
    """K-fold report of both models; ``even``: folds of equal size instead of
    the trial table's own ``fold`` column."""
    t = with_batch_features(drop_missing_targets(require_columns(trials(spark, sf_dir))))
    if even:
        used = list(dict.fromkeys([*keys, *FULL_GROUPS, "log2_batch_size", TARGET_FULL, TARGET_BASE, *KEY_COLS[:-1]]))
        # Rows of the fixture may share all four keys.
        t = even_folds(t.select(*used), KEY_COLS[:-1], KFOLD_SPLITS, KFOLD_SEED, ties=(TARGET_FULL, TARGET_BASE, *FULL_GROUPS))
    t = reports.category_keys(t, keys)
    # one pass: models and report sums from the same aggregate
    if predictor == "linear":
        return reports.kfold_report_from(linear_report_sums(t, "fold", keys), keys)
    if predictor == "mean":
        sums = predict.group_mean_report_sums(t, "fold", [("pred_full", TARGET_FULL, FULL_GROUPS),
                                                          ("pred_base", TARGET_BASE, BASE_GROUPS)],
                                              TARGET_FULL, keys)
        return reports.kfold_report_from(reports.analytic_sums(sums), keys)
    raise ValueError(f"unknown predictor {predictor!r}")


def linear_report_sums(df: DataFrame, fold_col: str, keys, x: str = "log2_batch_size",
                       min_rows: int | None = None) -> DataFrame:
    """Both linear models (full, base) fitted out of fold and summarised at
    (fold, *keys) from one pass; ``min_rows`` keeps held-out folds only."""
    sums = predict.linear_report_sums(df, fold_col, x, [("pred_full", TARGET_FULL),
                                                        ("pred_base", TARGET_BASE)], TARGET_FULL, keys)
    if min_rows is not None:
        held = sums.groupBy(fold_col).agg(F.sum("n").alias("n"))
        held = held.where(F.col(fold_col).isNotNull() & (F.col("n") >= min_rows)).select(fold_col)
        sums = sums.join(held, fold_col, "left_semi")
    return reports.analytic_sums(sums)


def logo_sums(spark: SparkSession, sf_dir: str, gpu: str = "gpu_name") -> DataFrame:
    """Leave-one-GPU-out linear models summarised at (gpu, model, vcpu,
    storage, batch_size), one pass over the trials."""
    t = with_batch_features(drop_missing_targets(require_columns(trials(spark, sf_dir))))
    return linear_report_sums(t, gpu, reports.LOGO_KEYS, min_rows=MIN_HELDOUT_ROWS)


def logo_predictions(df: DataFrame, gpu: str = "gpu_name", predictor: str = "linear",
                     x: str = "log2_batch_size", min_rows: int = MIN_HELDOUT_ROWS) -> DataFrame:
    """Leave-one-GPU-out predictions (M4): every known GPU with enough rows
    is predicted by models trained on all other rows (unknown-GPU rows and
    small GPUs only ever train)."""
    return kfold_predictions(df, gpu, predictor, x, min_rows=min_rows)
