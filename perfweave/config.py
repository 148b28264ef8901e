"""Per-family parameters of the evaluation workflow.

The three model families (CNN, MLP, Transformer) share one implementation;
what differs between them is data, collected here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must equal the workflow being reproduced for equal results).
# ---------------------------------------------------------------------------

# Timing columns that would leak the measured time into the features
# (CNN and MLP evaluators).
LEAKY_IMAGE = (
    "avg_batch_time_ms", "p90_batch_time_ms", "T_gpu_ms", "T_cpu_io_ms",
    "T_step_ms", "loader_ratio", "loader_wait_ms", "compute_ms",
    "p50_batch_ms", "batch_time_p50_ms", "std_batch_ms", "avg_loader_ms",
    "avg_compute_ms", "iter_time_ms", "iteration_time_ms", "batch_time_ms",
    "time_ms",
)
# Transformer evaluators.
LEAKY_TRANSFORMER = (
    "avg_batch_time_ms", "p90_batch_time_ms", "T_gpu_ms", "T_cpu_io_ms",
    "T_step_ms", "loader_ratio", "examples_per_sec", "tokens_per_sec",
)
# Identifier / text columns never used as features.
ID_TEXT_IMAGE = ("gpu_name", "dataset", "input_shape", "optimizer", "model",
                 "Bus", "Memory Type")
ID_TEXT_TRANSFORMER = ("gpu_name", "dataset", "optimizer", "model",
                       "architecture", "arch_family", "activation", "norm_style",
                       "norm_impl", "positional_encoding", "attention_pattern",
                       "bottleneck", "Memory Type", "Bus")
# Categorical GPU/host columns that are one-hot encoded (drop-first).  The
# spec dimension here stores "Memory Type" / "Bus" as mem_type / bus.
CATEGORICAL_IMAGE = ("mem_type", "bus", "gpu_arch", "storage")
CATEGORICAL_TRANSFORMER = ("mem_type", "bus", "storage")

# Targets.
TARGET_FULL = "avg_batch_time_ms"   # whole-iteration model ("full")
TARGET_BASE = "T_gpu_ms"            # GPU-only baseline ("base")

# Regressor settings of the published evaluations (library default).
GBT_DEFAULTS = dict(max_iter=800, step_size=0.045, max_depth=9,
                    subsampling_rate=0.9, feature_subset="0.9", l2=1.2, seed=42)

# Protocol constants.
KFOLD_SPLITS = 5
KFOLD_SEED = 42
MIN_GROUP_ROWS = 2      # groups with fewer rows are left out of K-fold reports
MIN_HELDOUT_ROWS = 3    # GPUs with fewer rows are never held out
WARMUP_STEPS = 5
MEASURE_STEPS = 20


@dataclass(frozen=True)
class FamilyConfig:
    name: str
    leaky: tuple
    id_cols: tuple
    categorical: tuple
    flops_prefix: str            # F_CNN / F_MLP / F_TR
    amp_col: str                 # column holding the AMP flag
    vram_from_total_bytes: bool  # use total_vram_bytes when present
    sm_fallback: bool            # SM falls back to sm_count
    ablation: str                # "image" | "none" | "host"
    impute: bool                 # train-median imputation before fitting
    keep_arch_family: bool = False   # Transformer writes arch_family_inferred
    extra_exclude: tuple = field(default_factory=tuple)

    def ablate(self, cols):
        """Feature names the GPU-only baseline keeps (host features removed)."""
        if self.ablation == "none":
            return list(cols)
        if self.ablation == "image":
            return [c for c in cols
                    if "vcpu" not in c.lower() and not c.lower().startswith("storage_")]
        return [c for c in cols
                if "vcpu" not in c.lower() and "storage" not in c.lower()]


CNN = FamilyConfig("CNN", LEAKY_IMAGE, ID_TEXT_IMAGE, CATEGORICAL_IMAGE, "F_CNN",
                   "amp", True, True, "image", False)
MLP = FamilyConfig("MLP", LEAKY_IMAGE, ID_TEXT_IMAGE, CATEGORICAL_IMAGE, "F_CNN",
                   "amp", True, True, "none", False)
TRANSFORMER = FamilyConfig("Transformer", LEAKY_TRANSFORMER, ID_TEXT_TRANSFORMER,
                           CATEGORICAL_TRANSFORMER, "F_TR", "amp_enabled", False,
                           False, "host", True, keep_arch_family=True)
# Leave-one-GPU-out evaluators ablate like the Transformer one and impute.
CNN_LOGO = FamilyConfig("CNN", LEAKY_IMAGE, ID_TEXT_IMAGE, CATEGORICAL_IMAGE, "F_CNN",
                        "amp", True, True, "host", True)
MLP_LOGO = FamilyConfig("MLP", LEAKY_IMAGE, ID_TEXT_IMAGE, CATEGORICAL_IMAGE, "F_MLP",
                        "amp", True, True, "host", True)

FAMILIES = {"CNN": CNN, "MLP": MLP, "Transformer": TRANSFORMER,
            "CNN_LOGO": CNN_LOGO, "MLP_LOGO": MLP_LOGO}
