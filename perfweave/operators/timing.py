"""Step-log rollup: raw per-step timings -> one timing row per trial
(W1, A1, A2, X23).

The warm-up window is a per-trial ``row_number`` with an upper bound, which
Catalyst turns into a WindowGroupLimit: each task keeps at most
``warmup + measure`` steps per trial *before* the shuffle, so a trial that
holds a third of all steps still ships only a few rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MEASURE_STEPS, WARMUP_STEPS
from ..functions.estimators import step_time_columns


def measured_steps(steps: DataFrame, trial: str = "trial_id", order=("ts", "event_id"),
                   warmup: int = WARMUP_STEPS, measure: int = MEASURE_STEPS) -> DataFrame:
    """Steps warmup+1 .. warmup+measure of each trial, in (ts, event_id)
    order (W1).  OOM steps keep their position (they were attempted)."""
    w = Window.partitionBy(trial).orderBy(*order)
    return (steps.withColumn("step_idx", F.row_number().over(w))
                 .where((F.col("step_idx") > warmup) & (F.col("step_idx") <= warmup + measure)))


def trial_timing(steps: DataFrame, trial: str = "trial_id", warmup: int = WARMUP_STEPS,
                 measure: int = MEASURE_STEPS, ratio_floor=None) -> DataFrame:
    """Mean and p90 step time, mean loader and compute time over measured,
    non-OOM steps; then T_gpu, T_cpu_io, T_step, loader ratio, bottleneck
    (A1, X23).  A trial without a usable step gets missing values."""
    m = measured_steps(steps, trial, warmup=warmup, measure=measure)
    ok = ~F.coalesce(F.col("oom"), F.lit(False))
    total = F.when(ok, F.col("loader_ms") + F.col("compute_ms"))
    p90 = F.percentile(total, 0.9)  # at most ``measure`` values of a trial
    r = m.groupBy(trial).agg(
        F.count(total).alias("n_steps"),
        F.avg(total).alias("avg_batch_time_ms"),
        p90.alias("p90_batch_time_ms"),
        F.avg(F.when(ok, F.col("loader_ms"))).alias("avg_loader_ms"),
        F.avg(F.when(ok, F.col("compute_ms"))).alias("avg_compute_ms"))
    r = r.withColumns({"T_gpu_ms": F.col("avg_compute_ms"), "T_cpu_io_ms": F.col("avg_loader_ms")})
    return r.withColumns(step_time_columns(ratio_floor=ratio_floor))


def trial_throughput(steps: DataFrame, trial: str = "trial_id",
                     warmup: int = WARMUP_STEPS, measure: int = MEASURE_STEPS) -> DataFrame:
    """Examples / tokens per second of compute time (A2).

    Every step's compute time counts in the denominator; its examples and
    tokens count once its forward pass has finished (``fwd_done``; without
    that column, unless it ran out of memory); no measured time -> missing;
    no tokens -> missing.
    """
    m = measured_steps(steps, trial, warmup=warmup, measure=measure)
    ok = ~F.coalesce(F.col("oom"), F.lit(False))
    if "fwd_done" in steps.columns:
        ok = F.coalesce(F.col("fwd_done"), ok)
    r = m.groupBy(trial).agg(
        (F.sum("compute_ms") / 1000.0).alias("measured_s"),
        F.sum(F.when(ok, F.col("n_examples")).otherwise(0)).cast("bigint").alias("n_examples"),
        F.sum(F.when(ok, F.col("n_tokens")).otherwise(0)).cast("bigint").alias("n_tokens"))
    pos = F.col("measured_s") > 0
    return r.select(trial, "n_examples", "n_tokens",
                    F.when(pos, F.col("n_examples") / F.col("measured_s")).alias("examples_per_sec"),
                    F.when(pos & (F.col("n_tokens") > 0), F.col("n_tokens") / F.col("measured_s"))
                     .alias("tokens_per_sec"))
