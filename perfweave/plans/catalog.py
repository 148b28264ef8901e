"""Registered queries: one callable per operator key of the coverage list.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the driver's
tables (or data Spark derives from them), so its work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CNN, CNN_LOGO, GBT_DEFAULTS, KFOLD_SEED, KFOLD_SPLITS, MIN_HELDOUT_ROWS, MLP, MLP_LOGO, TARGET_BASE, TARGET_FULL, TRANSFORMER
from ..functions.estimators import memory_estimate, storage_label
from ..functions.nulls import canon_missing
from ..operators.features import stats_frame
from ..operators.joins import enrich_with_spec
from ..operators import folds, gbt, grid, layers, matrix, predict, ridge, text, timing
from ..operators.features import engineer, engineer_with_dimension
from ..operators.profile import profile, skew_candidates
from ..operators.train_features import train_features
from ..sources import fixtures, manifest
from ..sources import reports as report_src
from ..sources.csv_files import read_csv
from ..sources.tables import read_table
from ..sources.trials import (dedup_columns, drop_missing_targets, order_columns, slug, trials,
                              union_trials)
from ..storage import written
from ..streaming import step_stream
from . import evaluate, reports
from .evaluate import KEY_COLS

RATIO_FLOOR = 1e-9  # smallest denominator of the Transformer family's loader ratio

ROW_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


# ---------------------------------------------------------------- sources ---

def scan_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + generator-derived columns: the trial fact table."""
    return trials(spark, sf_dir)


def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with both targets."""
    return drop_missing_targets(trials(spark, sf_dir)).select(*ROW_KEYS, TARGET_FULL, TARGET_BASE)


CANON_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_partkey % 89 = 0 THEN CAST('NaN' AS DOUBLE)
       WHEN l_partkey % 83 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN l_partkey % 79 = 0 THEN CAST('-Infinity' AS DOUBLE)
       ELSE l_tax * 100.0 END AS loader_wait_ms,
  l_extendedprice / 1000.0 AS compute_ms
FROM {lineitem}
"""


def canon_missing_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN / +-inf become NULL in every floating column."""
    raw = spark.sql(CANON_SQL, lineitem=read_table(spark, sf_dir, "lineitem"))
    return canon_missing(raw)


def gpu_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 over page URLs (they contain reserved characters)."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", slug("url").alias("slug"))


def trial_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials left-joined to the GPU specification dimension."""
    t = trials(spark, sf_dir).select(*ROW_KEYS, "gpu_name", "batch_size")
    return enrich_with_spec(t, fixtures.gpu_spec(spark))


def union_trials_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-GPU trial tables with different columns, unioned by name."""
    t = trials(spark, sf_dir)
    a = t.where(F.col("l_suppkey") % 2 == 0).select(*ROW_KEYS, "gpu_name", "T_gpu_ms", "T_cpu_io_ms")
    b = t.where(F.col("l_suppkey") % 2 == 1).select(*ROW_KEYS, "gpu_name", "T_gpu_ms", "avg_batch_time_ms")
    return union_trials([a, b])


# --------------------------------------------------------------- features ---

def _features(spark: SparkSession, sf_dir: str, log1p: bool = False) -> DataFrame:
    return evaluate.evaluation_features(spark, sf_dir, CNN, log1p=log1p)


def _feature_query(cols, log1p: bool = False):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _features(spark, sf_dir, log1p).select(*ROW_KEYS, *cols)
    return q


FEATURE_GROUPS = {
    "hw_ratios": ["flops_to_bw_ratio", "flops_to_FP32_ratio", "flops_to_FP16_ratio",
                  "flops_to_FP64_ratio", "bw_per_gb", "ai_over_fp32", "FP16_per_trainflop",
                  "FP32_per_trainflop"],
    "mem_pressure": ["mem_pressure", "mem_headroom", "near_vram_limit"],
    "batch_features": ["log2_batch_size", "batch_bin_small", "batch_bin_medium", "batch_bin_large"],
    "batch_hw": ["B_per_SM", "B_over_GB", "B_times_BW", "B_times_SM", "B_times_tc",
                 "B_times_headroom", "B_times_arch_Ampere", "B_times_arch_Ada", "B_times_arch_Hopper"],
    "roofline": ["roof_time_ms"],
    "tc_util": ["amp", "tc_util_proxy"],
    "flops_features": ["F_CNN_sample", "F_CNN_batch", "log_F_CNN_sample", "log_F_CNN_batch"],
    "one_hot": ["mem_type_GDDR7", "mem_type_HBM2", "mem_type_HBM2e", "mem_type_nan",
                "bus_SXM2", "bus_nan", "gpu_arch_Ampere", "gpu_arch_Blackwell", "gpu_arch_Hopper",
                "gpu_arch_Turing", "gpu_arch_Volta", "gpu_arch_nan", "storage_SSD",
                "arch_Ampere", "arch_Hopper", "arch_Turing", "arch_Unknown"],
}


def gpu_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Architecture family per GPU name (with trial counts)."""
    f = _features(spark, sf_dir)
    return f.groupBy("gpu_name", "arch_family").agg(F.count(F.lit(1)).alias("n_trials"))


def gpu_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name / memory flags per GPU (with trial counts)."""
    f = _features(spark, sf_dir)
    return (f.groupBy("gpu_name", "has_tensor_cores", "is_pcie", "is_sxm", "is_datacenter", "has_HBM")
             .agg(F.count(F.lit(1)).alias("n_trials")))


def median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row statistics job behind the fills."""
    e = evaluate.evaluation_trials(spark, sf_dir)
    return stats_frame(e, CNN).select("med_bw", "med_sm", "med_roof", "n_vram")


def skew_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-pass profile of every candidate column and the log1p decision."""
    f = _features(spark, sf_dir)
    cols = skew_candidates(f, TARGET_FULL, CNN.leaky, KEY_COLS)
    return profile(f, cols)


def log1p_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 applied: the log1p twins of the heavy-tailed columns."""
    f = _features(spark, sf_dir, log1p=True)
    logs = [c for c in f.columns if c.startswith("log1p__")]
    return f.select(*ROW_KEYS, *logs)


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full model's feature matrix (doubles) with its target."""
    f = _features(spark, sf_dir, log1p=True)
    full, _ = evaluate.model_features(f, CNN)
    return f.select(*ROW_KEYS, *[F.col(c).cast("double").alias(c) for c in full], TARGET_FULL)


def feature_matrix_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 with fills, one-hot columns and log1p choices from the other folds' rows only."""
    f = train_features(evaluate.evaluation_trials(spark, sf_dir), CNN, TARGET_FULL, "fold", KEY_COLS)
    full, _ = evaluate.model_features(f, CNN)
    return f.select(*ROW_KEYS, *[F.col(c).cast("double").alias(c) for c in full], TARGET_FULL)


def feature_matrix_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GPU-only baseline's matrix (host features removed)."""
    f = _features(spark, sf_dir, log1p=True)
    _, base = evaluate.model_features(f, CNN)
    return f.select(*ROW_KEYS, *[F.col(c).cast("double").alias(c) for c in base], TARGET_BASE)


def feature_matrix_base_logo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, host ablation of the leave-one-GPU-out evaluators."""
    f = evaluate.evaluation_features(spark, sf_dir, CNN_LOGO)
    _, base = evaluate.model_features(f, CNN_LOGO)
    return f.select(*ROW_KEYS, *[F.col(c).cast("double").alias(c) for c in base], TARGET_BASE)


def feature_matrix_base_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 of the MLP family, which ablates nothing: the base model sees all features."""
    f = evaluate.evaluation_features(spark, sf_dir, MLP)
    _, base = evaluate.model_features(f, MLP)
    return f.select(*ROW_KEYS, *[F.col(c).cast("double").alias(c) for c in base], TARGET_BASE)


def choice_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, optional model and optimizer columns."""
    f = matrix.with_choices(_eval_trials(spark, sf_dir), include_model_oh=True, include_opt_oh=True)
    return f.select(*ROW_KEYS, *[c for c in f.columns if c.startswith(("model_", "opt_"))])


# ----------------------------------------------------- timing / estimators ---

def trial_timing_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + A1 + X23 over the step log."""
    return timing.trial_timing(fixtures.steps(spark, sf_dir))


def trial_timing_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + A1 + X23 with the Transformer family's floored ratio."""
    return timing.trial_timing(fixtures.steps(spark, sf_dir), ratio_floor=RATIO_FLOOR)


def trial_throughput_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 over the step log."""
    return timing.trial_throughput(fixtures.steps(spark, sf_dir))


def layer_flops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + A4 over the layer table."""
    return layers.layer_rollup(fixtures.layers(spark, sf_dir))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed host configurations: one pass over the trials, materialised
    as a small table (every grid job reads it)."""
    return written(grid.host_configs(trials(spark, sf_dir)), "hosts")


def grid_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + P9 + U3 + X24: CNN grid for every observed host configuration."""
    return grid.cnn_grid(_hosts(spark, sf_dir))


def flops_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18 (+X21) on the MLP grid."""
    g = grid.mlp_grid(_hosts(spark, sf_dir))
    return g.select("gpu_name", "storage", "vcpu", "model", "dataset", "embed_dim", "learning_rate",
                    "batch_size", "optimizer", "prec_bits", "depth", "patch_size", "num_patches",
                    "flops_fwd_per_sample", "flops_train_per_batch", "act_bytes_per_sample_proxy")


def flops_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19 (+X21) on the Transformer sweeps."""
    g = grid.transformer_grid(_hosts(spark, sf_dir))
    return g.select("gpu_name", "storage", "vcpu", "model", "dataset", "task", "optimizer",
                    "learning_rate", "batch_size", "prec_bits", "seq_len", "src_len", "tgt_len",
                    "d_head", "flops_fwd_per_token", "flops_train_per_seq", "flops_train_per_batch",
                    "act_bytes_per_seq_proxy")


def mem_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20-X22 on the trial table."""
    return trials(spark, sf_dir).select(
        *ROW_KEYS, "param_bytes", "optimizer_state_bytes", "master_param_bytes", "total_state_bytes",
        "act_bytes_per_sample_proxy", "arithmetic_intensity_train")


def mem_estimate_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20 with the Transformer family's optimizers, and the storage label."""
    g = grid.transformer_grid(_hosts(spark, sf_dir))
    d, ff = F.col("d_model").cast("bigint"), F.col("d_ff").cast("bigint")
    g = g.withColumns({"param_count": F.col("depth").cast("bigint") * (4 * d * d + 2 * d * ff),
                       "amp_enabled": F.col("prec_bits") == 16})
    g = memory_estimate(g, amp="amp_enabled", with_adafactor=True)
    return g.select("gpu_name", storage_label("storage").alias("storage"), "vcpu", "model", "dataset", "optimizer",
                    "learning_rate", "batch_size", "prec_bits", "param_bytes", "optimizer_state_bytes",
                    "master_param_bytes", "total_state_bytes")


def trial_timing_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23 on the trial table (T_step, loader ratio, bottleneck)."""
    return trials(spark, sf_dir).select(*ROW_KEYS, "T_step_ms", "loader_ratio", "bottleneck")


# ------------------------------------------------------- folds / predictors ---

def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: seeded hash fold per trial key."""
    t = trials(spark, sf_dir).select(*ROW_KEYS)
    return folds.assign_folds(t, ROW_KEYS, k=5, seed=42, out="fold_md5")


def kfold_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: shuffled folds of equal size (by at most one row)."""
    t = trials(spark, sf_dir).select(*ROW_KEYS)
    return folds.even_folds(t, ROW_KEYS, k=KFOLD_SPLITS, seed=KFOLD_SEED, out="fold_even").select(*ROW_KEYS, "fold_even")


def kfold_report_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 over folds of equal size (M2)."""
    return evaluate.kfold_report(spark, sf_dir, "linear", even=True)


def _eval_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_batch_features(drop_missing_targets(trials(spark, sf_dir)))


def oof_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-fold-out group means for every (fold, group) at once."""
    t = _eval_trials(spark, sf_dir)
    return predict.leave_out_group_mean(t, "fold", TARGET_FULL, evaluate.FULL_GROUPS, "pred_full")


def oof_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-fold-out regression coefficients of both models (k rows)."""
    t = _eval_trials(spark, sf_dir)
    sums = predict.linear_fold_sums(t, "fold", "log2_batch_size", [TARGET_FULL, TARGET_BASE])
    f = predict.leave_out_linear_from(sums, "fold", TARGET_FULL, "pred_full")
    b = predict.leave_out_linear_from(sums, "fold", TARGET_BASE, "pred_base")
    return f.join(b, "fold")


def oof_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + J7: out-of-fold predictions of both linear models, row by row."""
    return evaluate.kfold_predictions(_eval_trials(spark, sf_dir), "fold", "linear").select(
        *ROW_KEYS, "pred_full", "pred_base")


def logo_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + J7: leave-one-GPU-out predictions of both linear models, row by row."""
    return evaluate.logo_predictions(_eval_trials(spark, sf_dir)).select(*ROW_KEYS, "gpu_name", "pred_full", "pred_base")


# ----------------------------------------------------------------- LOGO ---

def logo_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M6a: leave-one-GPU-out group means of the GPU-only model."""
    t = _eval_trials(spark, sf_dir)
    return predict.leave_out_group_mean(t, "gpu_name", TARGET_BASE, evaluate.BASE_GROUPS, "pred_base")


def logo_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M6b: one leave-one-GPU-out regression per GPU, both targets."""
    t = _eval_trials(spark, sf_dir)
    sums = predict.linear_fold_sums(t, "gpu_name", "log2_batch_size", [TARGET_FULL, TARGET_BASE])
    held = sums.where(F.col("gpu_name").isNotNull() & (F.col("rows") >= MIN_HELDOUT_ROWS)).select("gpu_name")
    f = predict.leave_out_linear_from(sums, "gpu_name", TARGET_FULL, "pred_full")
    b = predict.leave_out_linear_from(sums, "gpu_name", TARGET_BASE, "pred_base")
    return f.join(b, "gpu_name").join(held, "gpu_name", "left_semi")


def logo_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + X25: per held-out GPU, errors by (model, vcpu|storage|batch)."""
    return reports.logo_breakdown_from(evaluate.logo_sums(spark, sf_dir))


def logo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + X27 + P10: per held-out GPU RMSE of both models."""
    return reports.logo_summary_from(evaluate.logo_sums(spark, sf_dir))


def logo_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakdown rows with their GPU's summary, from one aggregate."""
    return reports.logo_report_from(evaluate.logo_sums(spark, sf_dir))


def kfold_report_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-fold RMSE per model."""
    return evaluate.kfold_report(spark, sf_dir, "linear", keys=("model",))


def kfold_report_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 with the leave-fold-out group-mean predictors."""
    return evaluate.kfold_report(spark, sf_dir, "mean")


def _matrix(spark: SparkSession, sf_dir: str, fam=CNN):
    """Feature frame and all feature names of the full model."""
    f = evaluate.evaluation_features(spark, sf_dir, fam)
    return f, evaluate.model_features(f, fam)[0]


def fold_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-only median of every feature for every held-out GPU."""
    f, feats = _matrix(spark, sf_dir, CNN_LOGO)
    return predict.fold_medians(f.select("gpu_name", *feats), "gpu_name", feats)


def fold_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-fold-out mean and population std of every feature per K-fold fold."""
    f, feats = _matrix(spark, sf_dir)
    return predict.fold_moments(f.select("fold", *feats), "fold", feats)


def impute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 applied: every row's features imputed with the medians of the other GPUs' rows."""
    f, feats = _matrix(spark, sf_dir, CNN_LOGO)
    return predict.impute_with(f, predict.fold_medians(f.select("gpu_name", *feats), "gpu_name", feats), "gpu_name", feats).select(
        *ROW_KEYS, *feats)


def scale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 applied: every row's features standardised with the moments of the other folds' rows."""
    f, feats = _matrix(spark, sf_dir)
    return predict.scale_with(f, predict.fold_moments(f.select("fold", *feats), "fold", feats), "fold", feats).select(*ROW_KEYS, *feats)


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct report keys."""
    return trials(spark, sf_dir).select("model", "vcpu", "storage").distinct().orderBy("model", "vcpu", "storage")


def report_ymax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis limit = max over both RMSE columns of the LOGO summary."""
    s = reports.logo_summary_from(evaluate.logo_sums(spark, sf_dir))
    return report_src.report_ymax(s, "RMSE_full_ms", "RMSE_base_ms")


def format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K-fold report as display strings (2 decimals, 'nan')."""
    r = evaluate.kfold_report(spark, sf_dir, "linear")
    return r.select("model", "vcpu", "storage", *[reports.fmt(c, 2).alias(c) for c in
                                                  ("RMSE_full_ms", "RMSE_base_ms", "Improvement_pct")])


# ----------------------------------------------------------------- text ---

SEQ_LEN = 128   # classification / translation sequence length


def _doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.positioned_tokens(fixtures.corpus(spark, sf_dir), "doc_id", "text")


def tokenize_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased word tokens of every document."""
    c = fixtures.corpus(spark, sf_dir).select("doc_id", text.tokenize("text").alias("tokens"))
    return c.select("doc_id", F.array_join("tokens", " ").alias("tokens"),
                    F.size("tokens").cast("bigint").alias("n_tokens"))


def vocab_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 + W3 + W5: capped vocabulary with specials and deterministic ties."""
    return text.build_vocab(_doc_tokens(spark, sf_dir))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = fixtures.corpus(spark, sf_dir)
    voc = text.build_vocab(_doc_tokens(spark, sf_dir))
    enc = text.encode_ids(corpus, voc, "doc_id", "text", keep_tokens=SEQ_LEN)
    return enc.select("doc_id", text.truncate("ids", SEQ_LEN).alias("ids"))


def encode_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 + T4 + T5 + J5: ids of the first SEQ_LEN tokens, unknown -> <unk>."""
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", text.ids_text("ids").alias("ids"), F.size("ids").cast("bigint").alias("n_ids"))


def pad_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length padded ids and true lengths."""
    padded, length = text.pad("ids", SEQ_LEN)
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", text.ids_text(padded).alias("padded"), length.alias("length"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.pairs(spark, sf_dir)
    return p.select("pair_id", text.first_nonempty("src_primary", "src_fallback").alias("src"),
                    text.first_nonempty("tgt_primary", "tgt_fallback").alias("tgt"))


def corpus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source/target text with field fallback ('' when all are empty)."""
    return _pairs(spark, sf_dir)


def _placed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, written once, with numbers that sort like their keys."""
    return written(text.placed(_pairs(spark, sf_dir), "pair_id"), "pairs")


def _pair_vocab(pairs: DataFrame) -> DataFrame:
    toks = text.positioned_tokens(pairs, "place", "src", side=0).unionByName(
        text.positioned_tokens(pairs, "place", "tgt", side=1))
    return text.build_vocab(toks)


def vocab_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 + U4: one vocabulary over sources then targets."""
    return _pair_vocab(_placed_pairs(spark, sf_dir))


def encode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """<bos> ids <eos> cut to SEQ_LEN on both sides of every pair."""
    p = _placed_pairs(spark, sf_dir)  # one join of the corpus for both uses
    e = text.encode_columns(p, _pair_vocab(p), ["pair_id"], {"src": "src", "tgt": "tgt"}, keep_tokens=SEQ_LEN - 1)
    return e.select("pair_id", *[text.ids_text(text.wrap_truncate(c, SEQ_LEN)).alias(f"{c}_ids") for c in ("src", "tgt")])


# ------------------------------------------------------------- manifest ---

MANIFEST_EXTENSIONS = (".html",)


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(fixtures.page_files(spark, sf_dir), fixtures.classes(spark, sf_dir),
                             MANIFEST_EXTENSIONS)


def manifest_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + W2: files of known classes with label index."""
    return _manifest(spark, sf_dir)


def manifest_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + J3: mean bytes per sample of every class, 0.0 when empty."""
    return manifest.average_bytes(_manifest(spark, sf_dir), fixtures.classes(spark, sf_dir))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + W2 over real files: the pages written as an image folder and listed by ``binaryFile``."""
    root = fixtures.image_folder(spark, sf_dir)
    files = manifest.list_files(spark, root, (".txt",), r"/class=([^/]*)/page=\d+/[^/]+$")
    files = files.withColumn("page", F.regexp_extract("path", r"/page=(\d+)/", 1).cast("long"))
    idx = manifest.class_index(fixtures.classes(spark, sf_dir))
    return files.join(idx, "class_name").select("page", "label_idx", "n_bytes")


def manifest_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + J2: validation files kept only when the annotation file maps them to a class."""
    mapping = manifest.annotations(spark, fixtures.annotation_file(spark, sf_dir))
    return manifest.validation_manifest(fixtures.val_files(spark, sf_dir), mapping, fixtures.classes(spark, sf_dir),
                                        extensions=MANIFEST_EXTENSIONS)


def trial_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + J3: trials with the mean bytes per sample of their dataset."""
    t = trials(spark, sf_dir).select(*ROW_KEYS, "dataset")
    return manifest.with_dataset_bytes(t, fixtures.dataset_files(spark, sf_dir)).select(
        *ROW_KEYS, "dataset", "disk_bytes_per_sample")


# -------------------------------------------------------------- reports ---

def rendered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-(model, batch) LOGO table rendered as a text report with
    padded headers and units, as a published CSV would hold it."""
    b = reports.logo_breakdown_from(evaluate.logo_sums(spark, sf_dir)).where(F.col("breakdown") == "batch")
    return b.select(F.col("model").alias(" Model "), F.col("group_value").alias("Batch Size "),
                    reports.fmt("Actual_ms_mean", 2).alias("Actual (ms)"),
                    F.concat(reports.fmt("Pred_full_ms_mean", 2), F.lit(" ms")).alias(" Predicted (ms)"))


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + P3 + P4 + X26: resolve, clean and score a text report."""
    return report_src.clean_model_report(report_src.strip_header(rendered_report(spark, sf_dir)))


def dedup_columns_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + P6: duplicated column names reduced to the first, one column moved last."""
    t = trials(spark, sf_dir)
    dup = t.select(*ROW_KEYS, "gpu_name", "T_gpu_ms", F.col("T_cpu_io_ms").alias("T_gpu_ms"), "vcpu")
    return order_columns(dedup_columns(dup), last="gpu_name")


# ------------------------------------------------- transformer family ---

def transformer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9 + X10 (+ Transformer variants of X13, X14, X16) on the sweep grid
    of every observed host, enriched with the GPU specification."""
    g = grid.transformer_grid(_hosts(spark, sf_dir)).withColumn("amp_enabled", F.col("prec_bits") == 16)
    e = enrich_with_spec(g, fixtures.gpu_spec(spark))
    f = engineer(e, TRANSFORMER)
    return f.select("gpu_name", "storage", "vcpu", "model", "dataset", "optimizer", "learning_rate",
                    "batch_size", "prec_bits", "F_TR_seq", "F_TR_batch", "log_F_TR_seq", "log_F_TR_batch",
                    "eff_seq_len", "log_eff_seq_len", "F_TR_sample", "log_F_TR_sample", "amp",
                    "arch_family_inferred", "mem_pressure", "roof_time_ms")


def mlp_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 (MLP-named copy, F_MLP_*) + X11/X12 on the MLP grid of every
    observed host, enriched with the GPU specification."""
    g = grid.mlp_grid(_hosts(spark, sf_dir)).withColumn("amp", F.col("prec_bits") == 16)
    f = engineer_with_dimension(g, fixtures.gpu_spec(spark), MLP_LOGO)
    return f.select("gpu_name", "storage", "vcpu", "model", "dataset", "embed_dim", "learning_rate",
                    "batch_size", "optimizer", "prec_bits", "F_MLP_sample", "F_MLP_batch",
                    "log_F_MLP_sample", "log_F_MLP_batch", "log2_batch_size", "B_per_SM", "B_over_GB",
                    "arch_family", "has_tensor_cores", "tc_util_proxy")


# --------------------------------------------------------------- sinks ---

def write_trials_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + U1 roundtrip: write one folder per (architecture, GPU) under the
    shared checkpoint folder, read it back with merged schemas."""
    from ..sources.trials import scan_trials as read_trials, write_trials
    path = fixtures.shared_path(spark, "trials")
    write_trials(trials(spark, sf_dir).select(*ROW_KEYS, "architecture", "gpu_name", "T_gpu_ms"), path)
    return read_trials(spark, path).select(*ROW_KEYS, "architecture", "gpu_name", "gpu_slug", "T_gpu_ms")


def _csv_trials(spark: SparkSession, sf_dir: str):
    """Trials written as the generators do: files whose columns differ in order
    and in number, some with a line that does not fit; read back by name."""
    t = trials(spark, sf_dir).select(*ROW_KEYS, "gpu_name", "model", "vcpu", "storage", "batch_size", "learning_rate",
                                     "T_gpu_ms", "avg_batch_time_ms")
    path = fixtures.shared_path(spark, "trials-csv")
    t.where("l_suppkey % 2 = 0").drop("learning_rate").write.option("header", True).csv(f"{path}/a")
    broken = F.when(F.col("l_partkey") % 50 == 1, F.lit("n/a")).otherwise(F.col("batch_size").cast("string"))
    odd = t.where("l_suppkey % 2 = 1").withColumns({"batch_size": broken, "notes": F.col("model")})
    odd.select(*sorted(odd.columns, reverse=True)).write.option("header", True).csv(f"{path}/b")
    return read_csv(spark, path, t.schema)


def scan_trials_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + U1 from CSV files with different headers, columns by name."""
    return _csv_trials(spark, sf_dir)[0]


def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of those files that do not fit their header."""
    part = F.split("line", ",")
    return _csv_trials(spark, sf_dir)[1].select(
        *[F.get(part, F.lit(i)).cast("bigint").alias(k) for i, k in ((7, "l_orderkey"), (6, "l_partkey"), (5, "l_suppkey"), (8, "l_linenumber"))],
        F.get(part, F.lit(10)).alias("batch_size"), F.size(part).alias("n_fields"))


def stream_trial_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: the step-log rollup as a stateful stream; equals trial_timing."""
    return step_stream.stream_trial_timing_query(spark, sf_dir)


def stream_final_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 in event time: trials closed by timers; equals trial_timing."""
    return step_stream.stream_final_query(spark, sf_dir)


def stream_window_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 per event-time window, with a watermark."""
    return step_stream.stream_window_query(spark, sf_dir)


# ----------------------------------------------------------------- GBT ---

# The registered queries fit the full protocol (config.GBT_DEFAULTS); see
# README, known limits, for its time.
GBT_QUERY_PARAMS = GBT_DEFAULTS


def _gbt_frame(spark: SparkSession, sf_dir: str, fam=CNN):
    f = evaluate.evaluation_features(spark, sf_dir, fam)
    full, base = evaluate.model_features(f, fam)
    return f, full, base


def oof_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M5: 5-fold out-of-fold GBT predictions of both models -> report."""
    f, full, base = _gbt_frame(spark, sf_dir)
    pred = gbt.oof_gbt(f, "fold", [("pred_full", TARGET_FULL, full), ("pred_base", TARGET_BASE, base)],
                       keys=[*ROW_KEYS, "model", "vcpu", "storage"], params=GBT_QUERY_PARAMS)
    return reports.kfold_report(pred)


def logo_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M5: leave-one-GPU-out GBT predictions of both models -> summary."""
    f, full, base = _gbt_frame(spark, sf_dir, CNN_LOGO)
    held = [r[0] for r in predict.holdout_flags(f, "gpu_name", MIN_HELDOUT_ROWS)
            .where("held_out").select("gpu_name").collect()]
    pred = gbt.oof_gbt(f, "gpu_name", [("pred_full", TARGET_FULL, full), ("pred_base", TARGET_BASE, base)],
                       keys=[*ROW_KEYS, "model", "vcpu", "storage", "batch_size"], folds=sorted(held),
                       params=GBT_QUERY_PARAMS, impute=True)
    return reports.logo_summary(pred)


def oof_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M6c: leave-fold-out ridge of both models on the whole feature matrix -> report."""
    f, full, base = _gbt_frame(spark, sf_dir)
    pred = ridge.oof_ridge(f, "fold", [("pred_full", full, TARGET_FULL), ("pred_base", base, TARGET_BASE)],
                           keys=["model", "vcpu", "storage"])
    return reports.kfold_report(pred)


def logo_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M6c: leave-one-GPU-out ridge of both models on the whole feature matrix -> summary."""
    f, full, base = _gbt_frame(spark, sf_dir, CNN_LOGO)
    pred = ridge.oof_ridge(f, "gpu_name", [("pred_full", full, TARGET_FULL), ("pred_base", base, TARGET_BASE)],
                           keys=[], min_rows=MIN_HELDOUT_ROWS)
    return reports.logo_summary(pred)


REGISTRY = {
    "scan_trials": scan_trials,
    "drop_missing": drop_missing,
    "canon_missing": canon_missing_q,
    "gpu_slug": gpu_slug,
    "trial_enrich": trial_enrich,
    "union_trials": union_trials_q,
    "gpu_arch": gpu_arch,
    "gpu_flags": gpu_flags,
    **{k: _feature_query(v) for k, v in FEATURE_GROUPS.items()},
    "median_fill": median_fill,
    "skew_profile": skew_profile,
    "log1p_features": log1p_features,
    "feature_matrix": feature_matrix,
    "feature_matrix_base": feature_matrix_base,
    "feature_matrix_train": feature_matrix_train,
    "trial_timing": trial_timing_q,
    "trial_throughput": trial_throughput_q,
    "layer_flops": layer_flops,
    "grid_trials": grid_trials,
    "flops_mlp": flops_mlp,
    "flops_transformer": flops_transformer,
    "mem_estimate": mem_estimate,
    "trial_timing_cols": trial_timing_cols,
    "kfold_assign": kfold_assign,
    "kfold_even": kfold_even,
    "kfold_report_even": kfold_report_even,
    "feature_matrix_base_logo": feature_matrix_base_logo,
    "feature_matrix_base_mlp": feature_matrix_base_mlp,
    "choice_one_hot": choice_one_hot,
    "trial_timing_tr": trial_timing_tr,
    "mem_estimate_tr": mem_estimate_tr,
    "oof_predict": oof_predict,
    "logo_predict": logo_predict,
    "impute_rows": impute_rows,
    "scale_rows": scale_rows,
    "oof_mean": oof_mean,
    "oof_linear": oof_linear,
    "oof_ridge": oof_ridge,
    "logo_ridge": logo_ridge,
    "logo_mean": logo_mean,
    "logo_linear": logo_linear,
    "logo_breakdown": logo_breakdown,
    "logo_summary": logo_summary,
    "logo_report": logo_report,
    "kfold_report_overall": kfold_report_overall,
    "kfold_report_mean": kfold_report_mean,
    "fold_impute": fold_impute,
    "fold_scale": fold_scale,
    "distinct_keys": distinct_keys,
    "report_ymax": report_ymax,
    "format_report": format_report,
    "tokenize": tokenize_q,
    "vocab": vocab_q,
    "encode": encode_q,
    "pad": pad_q,
    "corpus_pairs": corpus_pairs,
    "vocab_pairs": vocab_pairs,
    "encode_pairs": encode_pairs,
    "manifest": manifest_q,
    "manifest_bytes": manifest_bytes,
    "manifest_val": manifest_val,
    "manifest_files": manifest_files,
    "clean_report": clean_report,
    "dedup_columns": dedup_columns_q,
    "transformer_features": transformer_features,
    "mlp_features": mlp_features,
    "trial_bytes": trial_bytes,
    "scan_trials_csv": scan_trials_csv,
    "csv_quarantine": csv_quarantine,
    "write_trials": write_trials_q,
    "stream_trial_timing": stream_trial_timing,
    "stream_final_timing": stream_final_timing,
    "stream_window_rollup": stream_window_rollup,
    "oof_gbt": oof_gbt,
    "logo_gbt": logo_gbt,
}
