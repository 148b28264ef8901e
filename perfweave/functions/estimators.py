"""Closed-form cost estimators as Column expressions.

All products are computed in double or bigint: INT32 products overflow (and
raise under ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import col_, dbl


def optimizer_state_multiplier(opt, with_adafactor: bool = False) -> Column:
    """2 for adam / adamw (and adafactor in the Transformer family), else 1."""
    names = ["adam", "adamw"] + (["adafactor"] if with_adafactor else [])
    return F.when(F.lower(col_(opt)).isin(*names), F.lit(2)).otherwise(F.lit(1)).cast("bigint")


def act_bytes_per_scalar(precision_bits) -> Column:
    return F.when(col_(precision_bits) == 16, F.lit(2)).otherwise(F.lit(4)).cast("bigint")


def memory_estimate(df: DataFrame, param_count="param_count", optimizer="optimizer",
                    amp="amp", with_adafactor: bool = False) -> DataFrame:
    """param/optimizer/master/total state bytes."""
    pb = col_(param_count).cast("bigint") * F.lit(4)
    return (df.withColumn("param_bytes", pb)
              .withColumns({
                  "optimizer_state_bytes": F.col("param_bytes") * optimizer_state_multiplier(optimizer, with_adafactor),
                  "master_param_bytes": F.when(col_(amp), F.col("param_bytes")).otherwise(F.lit(0).cast("bigint")),
              })
              .withColumn("total_state_bytes", F.col("param_bytes") + F.col("optimizer_state_bytes")
                          + F.col("master_param_bytes")))


def arithmetic_intensity(train_flops, param_bytes, act_bytes) -> Column:
    """``train_flops / max(1, param_bytes + act_bytes)``."""
    return dbl(train_flops) / F.greatest(F.lit(1.0), dbl(param_bytes) + dbl(act_bytes))


def image_mlp_forward_flops(model, image_size, patch_size, in_chans, embed_dim, depth,
                            token_mlp_dim, channel_mlp_dim) -> tuple[Column, Column]:
    """(num_patches, forward FLOPs per sample) of an image MLP.

    An unknown model name raises at run time, as the estimator has no formula
    for it.
    """
    P = F.pow(F.floor(dbl(image_size) / dbl(patch_size)), 2)
    D = dbl(embed_dim)
    patch_dim = dbl(in_chans) * dbl(patch_size) * dbl(patch_size)
    f_patch = P * (2.0 * patch_dim * D)
    f_ln = 4.0 * P * D
    f_channel = 4.0 * P * D * dbl(channel_mlp_dim)
    name = F.lower(col_(model))
    f_block = (F.when(name == "mixer", 4.0 * D * P * dbl(token_mlp_dim) + f_channel + f_ln)
               .when(name == "resmlp", 2.0 * D * P * P + f_channel + f_ln)
               .when(name == "asmlp", P * (4.0 * D * D) + f_channel + f_ln)
               .otherwise(F.raise_error(F.concat(F.lit("Unknown model for FLOPs: "),
                                                 col_(model).cast("string"))).cast("double")))
    return P.cast("bigint"), f_patch + dbl(depth) * f_block


def transformer_block_flops(seq_len, d_model, n_heads, d_ff) -> Column:
    """``4 d^2 + 2 seq d d_head + 2 d d_ff`` with ``d_head = max(1, d // heads)``."""
    d = dbl(d_model)
    d_head = F.greatest(F.lit(1.0), F.floor(d / dbl(n_heads)))
    return 4.0 * d * d + 2.0 * dbl(seq_len) * d * d_head + 2.0 * d * dbl(d_ff)


def step_time_columns(gpu_ms="T_gpu_ms", io_ms="T_cpu_io_ms", ratio_floor=None) -> dict:
    """T_step, loader_ratio and bottleneck from mean GPU and host times.

    ``ratio_floor=None``: ratio is missing unless io+gpu > 0 (CNN/MLP);
    a float: denominator ``max(floor, io+gpu)`` (Transformer).
    """
    g, h = dbl(gpu_ms), dbl(io_ms)
    tot = h + g
    if ratio_floor is None:
        ratio = F.when(tot > 0, h / tot)
    else:
        ratio = F.when(h.isNotNull(), h / F.when(tot.isNotNull(), F.greatest(F.lit(float(ratio_floor)), tot)))
    return {
        # max(gpu, io) keeps the GPU value when the host value is missing
        "T_step_ms": F.when(g.isNull(), F.lit(None).cast("double"))
                      .when(h.isNull(), g).otherwise(F.greatest(g, h)),
        "loader_ratio": ratio,
        "bottleneck": F.when(F.coalesce(g > h, F.lit(False)), "gpu").otherwise("host"),
    }


def storage_label(storage) -> Column:
    """Missing or NVME (any case) -> NVME, otherwise SSD."""
    s = col_(storage)
    return F.when(s.isNull() | (F.upper(s) == "NVME"), "NVME").otherwise("SSD")


def clamp_workers(workers, cap) -> Column:
    """``max(0, min(w, cap))``."""
    return F.greatest(F.lit(0), F.least(col_(workers), col_(cap)))
