"""Trial-grid expansion (J6, P9, X24, U3) and per-trial cost estimates.

For every host configuration observed in the trial table, the default
hyper-parameter grid of a model family is expanded with ``explode`` chains
(a generator per row, no join).  Allowed (model, dataset) pairs are a
left-semi join to a fixed literal table, broadcast because its size is fixed
in the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.estimators import (act_bytes_per_scalar, clamp_workers,
                                    image_mlp_forward_flops, transformer_block_flops)
from ..functions.nulls import dbl

# ---------------------------------------------------------------------------
# Default grids of the measurement scripts.
# ---------------------------------------------------------------------------
KNOWN_IMAGE_DATASETS = ("CIFAR10", "CIFAR100", "TinyImageNet", "STL10")
WORKER_SWEEP = (4, 8, 16)
PRECISIONS = (16, 32)

CNN_MODELS = ("resnet50", "vgg16", "densenet121")
CNN_DATASETS = ("CIFAR10", "CIFAR100", "TinyImageNet", "STL10")
CNN_BATCH = (32, 64, 128, 256)
CNN_LRS = (5e-4, 1e-3, 2e-3)
CNN_OPTIMIZERS = ("SGD", "AdamW")
CNN_ALLOWED = (("resnet50", "TinyImageNet"), ("resnet50", "CIFAR10"),
               ("vgg16", "TinyImageNet"), ("vgg16", "CIFAR100"),
               ("mobilenetv2", "CIFAR10"), ("mobilenetv2", "STL10"),
               ("densenet121", "CIFAR100"), ("densenet121", "TinyImageNet"))

MLP_MODELS = ("mixer", "resmlp", "asmlp")
MLP_DATASETS = ("CIFAR100", "TinyImageNet", "STL10")
MLP_BATCH = (32, 128, 256)
MLP_LRS = (5e-4, 1e-3, 2e-3)
MLP_OPTIMIZERS = ("AdamW", "SGD")
MLP_EMBED_DIMS = (128, 256)
MLP_ALLOWED = (("mixer", "TinyImageNet"), ("mixer", "STL10"),
               ("resmlp", "CIFAR100"), ("resmlp", "TinyImageNet"),
               ("asmlp", "TinyImageNet"), ("asmlp", "STL10"))
# Image size by dataset: CIFAR100 32, TinyImageNet 64, STL10 96; patch 8
# (4 for asmlp on CIFAR100); default depth 12 (mixer: 10 on TinyImageNet,
# 8 otherwise) - written out in mlp_grid.

# (model, dataset, task, batches, learning rates, optimizers, sequence length)
TRANSFORMER_SWEEPS = (
    ("DistilBERT", "SST2", "text_cls", (8, 16, 32), (1e-4, 2e-4, 5e-4), ("AdamW", "Adafactor"), 128),
    ("DistilBERT", "IMDB", "text_cls", (8, 16, 32), (1e-4, 2e-4, 5e-4), ("AdamW", "Adafactor"), 128),
    ("DeiT-Tiny", "CIFAR100", "vision_cls", (32, 48, 64), (1e-3, 2e-3, 3e-3), ("AdamW", "Adam"), 196),
    ("DeiT-Tiny", "TinyImageNet", "vision_cls", (32, 48, 64), (1e-3, 2e-3, 3e-3), ("AdamW", "Adam"), 196),
    ("ViT", "CIFAR100", "vision_cls", (4, 8, 16), (5e-4, 1e-3, 2e-3), ("AdamW", "Adam"), 196),
    ("ViT", "STL10", "vision_cls", (4, 8, 16), (5e-4, 1e-3, 2e-3), ("AdamW", "Adam"), 196),
    ("Transformer", "WMT14_EN_DE", "seq2seq", (8, 16, 32), (3e-4, 5e-4, 1e-3), ("AdamW", "Adafactor"), 128),
    ("Transformer", "CNNDM_SUM", "seq2seq", (2, 4, 8), (2e-4, 3e-4, 5e-4), ("AdamW", "Adafactor"), 512),
)
# model -> (d_model, n_heads, d_ff, depth)
TRANSFORMER_DIMS = {"DistilBERT": (256, 8, 1024, 6), "DeiT-Tiny": (192, 3, 768, 12),
                    "ViT": (768, 12, 3072, 12), "Transformer": (512, 8, 2048, 12)}


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def explode_values(df: DataFrame, name: str, values) -> DataFrame:
    return df.withColumn(name, F.explode(_lits(values)))


def host_configs(trials: DataFrame) -> DataFrame:
    """One row per observed (GPU, storage tier) with its vCPU cap."""
    return (trials.groupBy("gpu_name", "storage")
                  .agg(F.greatest(F.lit(1), F.max("vcpu")).alias("vcpu_cap")))


def _pairs_table(spark: SparkSession, pairs) -> DataFrame:
    values = ", ".join(f"('{m}', '{d}')" for m, d in pairs)
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS a(model, dataset)")


def _with_workers(df: DataFrame) -> DataFrame:
    """Worker sweep clamped to the host's cap (X24).  Distinct sweep values
    that clamp to the same cap stay separate grid rows."""
    ws = F.transform(_lits(dict.fromkeys(WORKER_SWEEP)), lambda w: clamp_workers(w, F.col("vcpu_cap")))
    return df.withColumn("vcpu", F.explode(ws)).withColumn("vcpu", F.col("vcpu").cast("bigint"))


def _model_dataset_pairs(hosts: DataFrame, models, datasets, allowed) -> DataFrame:
    """models x (datasets known to the family), kept only if allowed."""
    spark = hosts.sparkSession
    known = [d for d in datasets if d in KNOWN_IMAGE_DATASETS]
    cand = explode_values(explode_values(hosts, "model", models), "dataset", known)
    return cand.join(F.broadcast(_pairs_table(spark, allowed)), ["model", "dataset"], "left_semi")


def cnn_grid(hosts: DataFrame) -> DataFrame:
    g = _model_dataset_pairs(hosts, CNN_MODELS, CNN_DATASETS, CNN_ALLOWED)
    for name, vals in (("optimizer", CNN_OPTIMIZERS), ("learning_rate", CNN_LRS),
                       ("batch_size", CNN_BATCH), ("prec_bits", PRECISIONS)):
        g = explode_values(g, name, vals)
    g = g.withColumn("batch_size", F.col("batch_size").cast("bigint"))
    return _with_workers(g).withColumn("architecture", F.lit("CNN"))


def mlp_grid(hosts: DataFrame) -> DataFrame:
    """MLP grid with dependent values and the closed-form FLOPs."""
    g = _model_dataset_pairs(hosts, MLP_MODELS, MLP_DATASETS, MLP_ALLOWED)
    g = explode_values(g, "embed_dim", MLP_EMBED_DIMS)
    ds, model = F.col("dataset"), F.col("model")
    image = F.when(ds == "CIFAR100", 32).when(ds == "TinyImageNet", 64).otherwise(96)
    depth = (F.when(ds == "TinyImageNet", F.when(model == "mixer", 10).otherwise(12))
              .otherwise(F.when(model == "mixer", 8).otherwise(12)))
    patch = F.when((ds == "CIFAR100") & (model == "asmlp"), 4).otherwise(8)
    g = g.withColumns({"channel_mlp_dim": 4 * F.col("embed_dim"),
                       "token_mlp_dim": F.greatest(F.lit(128), F.floor(F.col("embed_dim") / 2).cast("int")),
                       "depth": depth, "image_size": image, "patch_size": patch, "in_chans": F.lit(3)})
    for name, vals in (("learning_rate", MLP_LRS), ("batch_size", MLP_BATCH),
                       ("optimizer", MLP_OPTIMIZERS), ("prec_bits", PRECISIONS)):
        g = explode_values(g, name, vals)
    g = _with_workers(g.withColumn("batch_size", F.col("batch_size").cast("bigint")))
    n_patches, fwd = image_mlp_forward_flops("model", "image_size", "patch_size", "in_chans",
                                             "embed_dim", "depth", "token_mlp_dim", "channel_mlp_dim")
    g = g.withColumns({"num_patches": n_patches, "flops_fwd_per_sample": fwd})
    return g.withColumns({
        "flops_train_per_sample": F.col("flops_fwd_per_sample") * 3.0,
        "flops_train_per_batch": F.col("flops_fwd_per_sample") * 3.0 * dbl("batch_size"),
        "act_bytes_per_sample_proxy": (F.col("num_patches") * F.col("embed_dim")
                                       * act_bytes_per_scalar("prec_bits") * F.col("depth")),
        "architecture": F.lit("MLP")})


def _sweeps_array() -> Column:
    """The sweep list as a literal array of structs (expanded per host row)."""
    structs = []
    for m, d, task, bs, lrs, opts, L in TRANSFORMER_SWEEPS:
        dm, nh, ff, dep = TRANSFORMER_DIMS[m]
        structs.append(F.struct(F.lit(m).alias("model"), F.lit(d).alias("dataset"),
                                F.lit(task).alias("task"), F.lit(L).alias("cfg_len"),
                                F.lit(dm).alias("d_model"), F.lit(nh).alias("n_heads"),
                                F.lit(ff).alias("d_ff"), F.lit(dep).alias("depth"),
                                _lits(bs).alias("batches"), _lits(lrs).alias("lrs"),
                                _lits(opts).alias("opts")))
    return F.array(*structs)


def transformer_grid(hosts: DataFrame) -> DataFrame:
    """Transformer sweeps x workers x precisions with FLOPs / activation
    estimates (X19, X21, X22 inputs)."""
    g = hosts.select("*", F.inline(_sweeps_array()))
    g = (g.withColumn("optimizer", F.explode("opts"))
          .withColumn("learning_rate", F.explode("lrs"))
          .withColumn("batch_size", F.explode("batches"))
          .withColumn("batch_size", F.col("batch_size").cast("bigint")))
    g = explode_values(g, "prec_bits", PRECISIONS)
    g = _with_workers(g).drop("opts", "lrs", "batches")
    s2s = F.col("task") == "seq2seq"
    L = dbl("cfg_len")
    g = g.withColumns({
        "seq_len": F.when(~s2s, L),
        "src_len": L,
        "tgt_len": F.when(s2s, L),
        "tokens_per_seq": L,
        "arch_family": F.when(s2s, "encoder_decoder").otherwise("encoder_only"),
        "d_head": F.floor(F.col("d_model") / F.col("n_heads")).cast("bigint"),
    })
    block = transformer_block_flops("cfg_len", "d_model", "n_heads", "d_ff")
    return g.withColumns({
        "flops_fwd_per_token": block,
        "flops_train_per_seq": block * F.col("tokens_per_seq") * dbl("depth") * 3.0,
        "act_bytes_per_seq_proxy": (F.col("tokens_per_seq").cast("bigint") * (F.col("d_model") + F.col("d_ff"))
                                    * act_bytes_per_scalar("prec_bits")),
        "architecture": F.lit("Transformer"),
    }).withColumn("flops_train_per_batch", F.col("flops_train_per_seq") * dbl("batch_size"))
