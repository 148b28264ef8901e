"""Trial feature columns (X2-X17, M1) as whole-stage-codegen projections.

Data-dependent choices (one-hot categories, medians used as fills, whether a
column is entirely missing) come from ONE aggregate job, ``global_stats``,
whose single row is read on the driver; everything else is a lazy
projection, so Catalyst prunes features that a later step does not use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FamilyConfig
from ..functions import hardware as hw
from ..functions.nulls import as_category, clip01, dbl, guarded_max, is_truthy, safe_ratio
from ..storage import written
from .joins import bounded_broadcast
from .columns import arrays
from .predict import fold_medians, range_medians

GIB = float(1024 ** 3)

# Columns that depend only on the GPU (its name and specification).
SPEC_ONLY_CATEGORICALS = ("mem_type", "bus", "gpu_arch")


@dataclass
class Stats:
    """Whole-table statistics that parameterise the feature projection."""
    categories: dict        # column -> sorted category list (only if any non-missing)
    arch_families: list     # sorted inferred families
    median_bw: float | None
    median_sm: float | None
    median_roof: float | None
    vram_all_missing: bool
    median_eff_len: float | None = None
    roof_any: bool = True
    gpu_names: list | None = None
    has_null_name: bool = False


def _number(v, default=None) -> Column:
    """A statistic as a column: a number for all rows, or each row's own (train-only statistics)."""
    x = v if isinstance(v, Column) else F.lit(None if v is None else float(v)).cast("double")
    return x if default is None else F.coalesce(x, F.lit(default))


def _has(df: DataFrame, *cols) -> bool:
    return all(c in df.columns for c in cols)


def _sm_col(df: DataFrame, fam: FamilyConfig) -> Column | None:
    if "SM" in df.columns:
        return dbl("SM")
    if fam.sm_fallback and "sm_count" in df.columns:
        return dbl("sm_count")
    return None


def _amp_expr(df: DataFrame, fam: FamilyConfig) -> Column:
    if fam.amp_col in df.columns:
        return is_truthy(fam.amp_col)
    if "amp" in df.columns:
        return F.col("amp").cast("int")
    return F.lit(0)


def _act_col(fam: FamilyConfig) -> str:
    return "act_bytes_per_seq_proxy" if fam.flops_prefix == "F_TR" else "act_bytes_per_sample_proxy"


def _raw_roof(df: DataFrame, fam: FamilyConfig) -> Column:
    """max(compute time, memory time) before the median fill."""
    B = dbl("batch_size")
    amp = _amp_expr(df, fam)
    fp16 = dbl("FP16") if "FP16" in df.columns else F.lit(None).cast("double")
    fp32 = dbl("FP32") if "FP32" in df.columns else F.lit(None).cast("double")
    peak = F.when((amp == 1) & fp16.isNotNull(), fp16).otherwise(F.coalesce(fp32, F.lit(0.0)))
    flops = dbl("flops_train_per_batch") if "flops_train_per_batch" in df.columns else F.lit(None).cast("double")
    t_c = flops / F.greatest(F.lit(1e-9), peak) * 1000.0
    act = dbl(_act_col(fam)) if _act_col(fam) in df.columns else F.lit(0.0)
    bw = dbl("bw_gbs") if "bw_gbs" in df.columns else F.lit(None).cast("double")
    bw_bytes = F.coalesce(bw * GIB, F.lit(0.0))
    t_m = act * B / F.greatest(F.lit(1.0), bw_bytes) * 1000.0
    return F.when(t_c.isNotNull() & t_m.isNotNull(), F.greatest(t_c, t_m))


def _eff_len(df: DataFrame) -> Column:
    parts = [dbl(c) for c in ("seq_len", "tgt_len", "src_len") if c in df.columns]
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


def _totals_of(cats, name, hardware) -> list:
    """Statistics of rows of the per-GPU table."""
    arch = F.sort_array(F.collect_set(hw.arch_family("__name"))) if name else F.array().cast("array<string>")
    return [
        *[x for c in cats for x in (F.sort_array(F.array_distinct(F.flatten(F.collect_list(f"cats__{c}")))).alias(f"cats__{c}"),
                                    F.sum(f"n__{c}").alias(f"n__{c}"))],
        arch.alias("arch"), F.collect_set("__name").alias("names"),
        F.coalesce(F.sum(F.when(F.col("__name").isNull(), F.col("rows"))), F.lit(0)).alias("null_names"),
        *[F.percentile(f"__{k}", 0.5, F.col("rows")).alias(k) for k in hardware],
        F.coalesce(F.sum("n_vram"), F.lit(0)).alias("n_vram"), F.coalesce(F.sum("n_roof"), F.lit(0)).alias("n_roof")]


def stats_frame(df: DataFrame, fam: FamilyConfig, fold_col: str | None = None) -> DataFrame:
    """Whole-table statistics as a single-row DataFrame; with ``fold_col`` one
    row (held) per fold, of the other folds' rows.

    One aggregate per GPU name (row count, categories, non-missing counts)
    covers everything that depends on few values; the medians of the
    hardware columns are medians of its rows weighted by their counts.  Only
    the medians of per-trial columns read the facts again, as value counts
    cut into ranges (``predict.range_medians``): no group of values is ever in
    one task.
    """
    null = F.lit(None).cast("double")
    name = "gpu_name" if "gpu_name" in df.columns else None
    key = F.col(name) if name else F.lit(None).cast("string")
    cats = [c for c in fam.categorical if c in df.columns]
    sm = _sm_col(df, fam)
    hardware = {"med_bw": dbl("bw_gbs") if "bw_gbs" in df.columns else null, "med_sm": sm if sm is not None else null}
    per_trial = {"med_roof": _raw_roof(df, fam)}
    if fam.flops_prefix == "F_TR":
        per_trial["med_eff"] = _eff_len(df)
    aggs = [F.count(F.lit(1)).alias("rows"),
            (F.count("total_vram_bytes") if "total_vram_bytes" in df.columns else F.lit(0).cast("bigint")).alias("n_vram"),
            F.count(per_trial["med_roof"]).alias("n_roof"), *[F.count(c).alias(f"n__{c}") for c in cats]]
    by = [key.alias("__name"), *[x.alias(f"__{k}") for k, x in hardware.items()]]

    def gpu_rows(*folds) -> DataFrame:
        # Counts per GPU and categories first: the sets are then made of a small table's rows.
        names = [*(["__fold"] if folds else []), "__name", *[f"__{k}" for k in hardware]]
        cells = df.groupBy(*folds, *by, *[as_category(c).alias(f"__of_{c}") for c in cats]).agg(*aggs)
        return written(cells.groupBy(*names).agg(*[F.sum(c).alias(c) for c in ("rows", "n_vram", "n_roof", *[f"n__{c}" for c in cats])],
                                                 *[F.collect_set(f"__of_{c}").alias(f"cats__{c}") for c in cats]), "gpus")

    if fold_col is not None:
        # Every held-out fold gets the statistics of the other folds' GPU rows (small tables: GPUs x folds).
        per_gpu = gpu_rows(F.col(fold_col).alias("__fold"))
        held = written(per_gpu.where(F.col("__fold").isNotNull()).select(F.col("__fold").alias("held")).distinct(), "held")
        rest = per_gpu.join(F.broadcast(held), ~F.col("__fold").eqNullSafe(F.col("held")))
        total = held.join(rest.groupBy("held").agg(*_totals_of(cats, name, hardware)), "held", "left")
        values = df.select(F.col(fold_col).alias("__fold"), *[x.alias(k) for k, x in per_trial.items()])
        medians = fold_medians(values, "__fold", list(per_trial)).withColumnRenamed("__fold", "held").withColumnsRenamed({f"med__{k}": k for k in per_trial})
        return total.join(written(medians, "medians"), "held", "left")
    total = gpu_rows().agg(*_totals_of(cats, name, hardware))
    medians = {r["feature"]: r["median"] for r in range_medians(
        arrays(df, F.lit(None).cast("string"), per_trial.values()), list(per_trial), [None]).collect()}  # one or two numbers
    return total.withColumns({k: F.lit(medians.get(k)).cast("double") for k in per_trial})


def global_stats(df: DataFrame, fam: FamilyConfig) -> Stats:
    """Read the single stats row on the driver (categories, medians, counts)."""
    r = stats_frame(df, fam).collect()[0].asDict()
    cats = [c for c in fam.categorical if c in df.columns]
    categories = {c: list(r[f"cats__{c}"]) for c in cats if r[f"n__{c}"] > 0}
    return Stats(categories=categories, arch_families=list(r["arch"]),
                 median_bw=r["med_bw"], median_sm=r["med_sm"], median_roof=r["med_roof"],
                 vram_all_missing=(r["n_vram"] == 0), median_eff_len=r.get("med_eff"),
                 roof_any=r["n_roof"] > 0, gpu_names=list(r["names"]),
                 has_null_name=r["null_names"] > 0)


def one_hot_columns(col: str, categories: list, prefix: str | None = None,
                    value: Column | None = None) -> dict:
    """Drop-first one-hot in lexical order: ``{prefix}_{v}`` for all but the
    first category; missing is the category 'nan' (M1)."""
    v = value if value is not None else as_category(col)
    p = prefix or col
    return {f"{p}_{c}": (v == F.lit(c)).cast("int") for c in sorted(categories)[1:]}


def gpu_columns(df: DataFrame, fam: FamilyConfig, st: Stats) -> DataFrame:
    """Columns that depend only on the GPU: spec ratio, one-hot spec
    categoricals (M1), architecture family + dummies and name / memory flags
    (X2 part, X6, X7).  Works on the facts or on a one-row-per-GPU dimension."""
    new = {}
    if _has(df, "bw_gbs", "mem_gb"):
        new["bw_per_gb"] = safe_ratio("bw_gbs", "mem_gb")
    for c, cats in st.categories.items():
        if c in SPEC_ONLY_CATEGORICALS:
            new.update(one_hot_columns(c, cats))
    fam_col = "arch_family_inferred" if fam.keep_arch_family else "arch_family"
    if "gpu_name" in df.columns:
        df = df.withColumn(fam_col, hw.arch_family("gpu_name"))
        new.update(one_hot_columns(fam_col, st.arch_families, prefix="arch", value=F.col(fam_col)))
        new.update({
            "has_tensor_cores": hw.has_tensor_cores("gpu_name"),
            "is_pcie": hw.is_pcie("gpu_name"),
            "is_sxm": hw.is_sxm("gpu_name"),
            "is_datacenter": hw.is_datacenter("gpu_name"),
        })
    else:
        new.update({fam_col: F.lit("Unknown"), "has_tensor_cores": F.lit(0), "is_pcie": F.lit(0),
                    "is_sxm": F.lit(0), "is_datacenter": F.lit(0)})
    new["has_HBM"] = hw.has_hbm("mem_type") if "mem_type" in df.columns else F.lit(0)
    return df.withColumns(new)


def gpu_model_features(df: DataFrame, fam: FamilyConfig, st: Stats) -> DataFrame:
    """Per-trial hardware ratios (X2, X3) and the host categorical one-hot (M1)."""
    new = {}
    if _has(df, "flops_train_per_batch", "bw_gbs"):
        new["flops_to_bw_ratio"] = safe_ratio("flops_train_per_batch", "bw_gbs")
    for peak in ("FP32", "FP16", "FP64"):
        if _has(df, peak, "flops_train_per_batch"):
            new[f"flops_to_{peak}_ratio"] = safe_ratio("flops_train_per_batch", peak)
    if _has(df, "arithmetic_intensity_train", "FP32"):
        new["ai_over_fp32"] = safe_ratio("arithmetic_intensity_train", "FP32")
    for c, cats in st.categories.items():
        if c not in SPEC_ONLY_CATEGORICALS:
            new.update(one_hot_columns(c, cats))
    for peak in ("FP16", "FP32"):
        if _has(df, peak, "flops_train_per_batch"):
            new[f"{peak}_per_trainflop"] = safe_ratio(peak, "flops_train_per_batch")
    return df.withColumns(new) if new else df


def gpu_dimension(spark, st: Stats, spec: DataFrame, fam: FamilyConfig,
                  key: str = "gpu_name") -> DataFrame:
    """One row per GPU name seen in the trials (plus a NULL-name row when
    needed) with its spec and every GPU-only feature."""
    names = st.gpu_names or []
    rows = [(n,) for n in names] + ([(None,)] if st.has_null_name else [])
    dim = spark.createDataFrame(rows, f"{key} string").join(spec, key, "left")
    return gpu_columns(dim, fam, st)


def flops_features(df: DataFrame, fam: FamilyConfig, st: Stats) -> DataFrame:
    """Per-sample / per-batch FLOPs with the fallback chain and logs."""
    p = fam.flops_prefix
    B = dbl("batch_size")
    if p == "F_TR":
        seq = dbl("flops_train_per_seq") if "flops_train_per_seq" in df.columns else F.lit(None).cast("double")
        batch = dbl("flops_train_per_batch") if "flops_train_per_batch" in df.columns else seq * B
        eff = _eff_len(df)
        new = {"F_TR_seq": seq, "F_TR_batch": batch,
               "log_F_TR_seq": F.log1p(seq), "log_F_TR_batch": F.log1p(batch),
               "eff_seq_len": eff,
               "log_eff_seq_len": F.log1p(F.coalesce(eff, _number(st.median_eff_len, 1.0)))}
        if _has(df, "flops_train_per_batch", "batch_size"):
            sample = dbl("flops_train_per_batch") / F.greatest(F.lit(1.0), B)
            new.update({"F_TR_sample": sample, "log_F_TR_sample": F.log1p(sample)})
        else:
            new.update({"F_TR_sample": F.lit(None).cast("double"),
                        "log_F_TR_sample": F.lit(None).cast("double")})
        return df.withColumns(new)
    if "flops_train_per_sample" in df.columns:
        sample = dbl("flops_train_per_sample")
    elif "flops_fwd_per_sample" in df.columns:
        sample = dbl("flops_fwd_per_sample") * 3.0
    elif _has(df, "flops_train_per_batch", "batch_size"):
        sample = dbl("flops_train_per_batch") / F.greatest(F.lit(1.0), B)
    else:
        sample = F.lit(None).cast("double")
    batch = dbl("flops_train_per_batch") if "flops_train_per_batch" in df.columns else sample * B
    return df.withColumns({f"{p}_sample": sample, f"{p}_batch": batch,
                           f"log_{p}_sample": F.log1p(sample), f"log_{p}_batch": F.log1p(batch)})


def batch_hw_features(df: DataFrame, fam: FamilyConfig, st: Stats) -> DataFrame:
    """Batch bins, batch x hardware, memory pressure, AMP, roofline."""
    B = dbl("batch_size")
    null = F.lit(None).cast("double")
    sm = _sm_col(df, fam)
    sm = sm if sm is not None else null
    mem_gb = dbl("mem_gb") if "mem_gb" in df.columns else null
    bw = dbl("bw_gbs") if "bw_gbs" in df.columns else null
    s1 = {
        "log2_batch_size": F.log2(F.greatest(F.lit(1.0), B)),
        "batch_bin_small": (B <= 32).cast("int"),
        "batch_bin_medium": ((B > 32) & (B <= 128)).cast("int"),
        "batch_bin_large": (B > 128).cast("int"),
        # a missing or zero denominator means 1.0 (greatest skips the NULL)
        "B_per_SM": B / F.greatest(F.lit(1.0), F.nullif(sm, F.lit(0.0))),
        "B_over_GB": B / F.greatest(F.lit(1.0), F.nullif(mem_gb, F.lit(0.0))),
        "B_times_BW": B * F.coalesce(bw, _number(st.median_bw, 0.0)),
        "B_times_SM": B * F.coalesce(sm, _number(st.median_sm, 0.0)),
    }
    pb = dbl("param_bytes") if "param_bytes" in df.columns else F.lit(0.0)
    state = dbl("total_state_bytes") if "total_state_bytes" in df.columns else pb
    act_c = _act_col(fam)
    act = dbl(act_c) if act_c in df.columns else F.lit(0.0)
    required = state + act * B
    vram = F.coalesce(mem_gb, F.lit(0.0)) * GIB
    if fam.vram_from_total_bytes and "total_vram_bytes" in df.columns:
        if isinstance(st.vram_all_missing, Column):
            vram = F.when(st.vram_all_missing, vram).otherwise(dbl("total_vram_bytes"))
        elif not st.vram_all_missing:
            vram = dbl("total_vram_bytes")
    pressure = required / guarded_max(1.0, vram)
    s1["mem_pressure"] = pressure
    s1["amp"] = _amp_expr(df, fam)
    raw_roof = _raw_roof(df, fam)
    if fam.flops_prefix == "F_TR" and not st.roof_any:
        s1["roof_time_ms"] = F.lit(0.0)
    else:
        s1["roof_time_ms"] = F.coalesce(raw_roof, _number(st.median_roof))
    has_tc = F.col("has_tensor_cores").cast("int") if "has_tensor_cores" in df.columns else F.lit(0)
    df = df.withColumns(s1)
    s2 = {
        "mem_headroom": clip01(1.0 - F.col("mem_pressure")),
        "near_vram_limit": F.coalesce(F.col("mem_pressure") > 0.90, F.lit(False)).cast("int"),
        "tc_util_proxy": (F.col("amp") * has_tc).cast("int"),
    }
    df = df.withColumns(s2)
    s3 = {"B_times_tc": B * F.col("tc_util_proxy"),
          "B_times_headroom": B * F.col("mem_headroom")}
    for a in ("Ampere", "Ada", "Hopper"):
        c = f"arch_{a}"
        s3[f"B_times_arch_{a}"] = B * (F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0))
    return df.withColumns(s3)


def trial_columns(df: DataFrame, fam: FamilyConfig, st: Stats) -> DataFrame:
    """Per-trial features on a frame that already carries the GPU columns."""
    df = gpu_model_features(df, fam, st)
    df = flops_features(df, fam, st)
    return batch_hw_features(df, fam, st)


def engineer(df: DataFrame, fam: FamilyConfig, st: Stats | None = None) -> DataFrame:
    """The whole feature prefix, computed per row on an enriched frame."""
    st = st or global_stats(df, fam)
    return trial_columns(gpu_columns(df, fam, st), fam, st)


def engineer_with_dimension(trials: DataFrame, spec: DataFrame, fam: FamilyConfig, key: str = "gpu_name") -> DataFrame:
    """Features with GPU-only work done once per GPU.

    The stats job runs over ``trials`` left-joined to ``spec``; the GPU
    dimension (names from that job x spec, with every GPU-only feature) is
    then attached to the trials by ONE null-safe broadcast join, so per-row
    work is only the per-trial arithmetic.
    """
    enriched = trials.join(bounded_broadcast(spec), key, "left")
    st = global_stats(enriched, fam)
    dim = gpu_dimension(trials.sparkSession, st, spec, fam, key)
    d = bounded_broadcast(written(dim, "gpu-dimension").withColumnRenamed(key, "__dim_key"))
    joined = trials.join(d, trials[key].eqNullSafe(d["__dim_key"]), "left").drop("__dim_key")
    return trial_columns(joined, fam, st)
