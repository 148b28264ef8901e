"""Per-network statistics from a layer table (A3, A4).

The forward-hook counters of the measurement become one grouped aggregate
over a long layer table ``(model, layer_idx, kind, shapes...)``: partial
aggregation means a network with millions of layer rows costs one small
buffer per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import dbl

CONV, LINEAR, BN, ACT = "conv", "linear", "bn", "act"


def layer_rollup(layers: DataFrame, model: str = "model") -> DataFrame:
    k = F.col("kind")
    conv, lin = k == CONV, k == LINEAR
    g = F.greatest(F.lit(1), F.col("groups"))
    f_conv = (2.0 * (dbl("c_in") / dbl(g)) * dbl("c_out") * dbl("kh") * dbl("kw")
              * dbl("h_out") * dbl("w_out"))
    f_lin = 2.0 * dbl("in_features") * dbl("out_features")
    depthwise = conv & (g == F.col("c_in")) & (F.col("c_out") == F.col("c_in"))
    grouped = conv & ~depthwise & (g > 1)
    plain = conv & ~depthwise & (g <= 1)
    hwc = F.col("h_out").cast("bigint") * F.col("w_out") * F.col("c_out")
    flops = F.when(conv, f_conv).when(lin, f_lin).otherwise(0.0)
    r = layers.groupBy(model).agg(
        F.sum(flops).alias("flops_fwd_per_sample"),
        F.sum(F.when(plain & (F.col("kh") == 1) & (F.col("kw") == 1), f_conv).otherwise(0.0)).alias("f1"),
        F.sum(F.when(plain & (F.col("kh") == 3) & (F.col("kw") == 3), f_conv).otherwise(0.0)).alias("f3"),
        F.sum(F.when(depthwise, f_conv).otherwise(0.0)).alias("fd"),
        F.sum(F.when(depthwise | grouped, f_conv).otherwise(0.0)).alias("fg"),
        F.coalesce(F.sum(F.when(conv, hwc)), F.lit(0).cast("bigint")).alias("sum_hwC"),
        F.coalesce(F.max(F.when(conv, hwc)), F.lit(0).cast("bigint")).alias("max_hwC"),
        F.count_if(k == BN).alias("bn_layers"),
        F.count_if(k == ACT).alias("act_layers"),
        F.sum("act_scalars").cast("bigint").alias("act_scalars"),
        F.sum("n_params").cast("bigint").alias("param_count"),
        F.count_if(conv | lin).alias("depth"))
    tot = F.when(F.col("flops_fwd_per_sample") > 0, F.col("flops_fwd_per_sample")).otherwise(1.0)
    return r.select(model, "flops_fwd_per_sample",
                    (F.col("f1") / tot).alias("flops_1x1_frac"),
                    (F.col("f3") / tot).alias("flops_3x3_frac"),
                    (F.col("fd") / tot).alias("flops_depthwise_frac"),
                    (F.col("fg") / tot).alias("flops_grouped_frac"),
                    "act_scalars", "sum_hwC", "max_hwC", "bn_layers", "act_layers",
                    "param_count", "depth")
