"""DuckDB SQL oracles: an independent ANSI-SQL statement of each registered
query, run on the same parquet tables.  Fixture views are shared text (see
``sources.fixtures``); every operator on top of them is written out in SQL
here rather than generated from the Spark code.
"""

from __future__ import annotations

from .sources import fixtures as fx

RAW_TRIALS = fx.duckdb_view(fx.RAW_TRIALS_SQL)
GPU_SPEC = fx.gpu_spec_sql()


# Queries whose floating outputs are sums over many rows: compared at 4
# decimals (summation order differs between engines; fewer digits make a
# rounding tie between the two results ~100x less likely).
AGG_KEYS = {"kfold_report", "kfold_report_even", "kfold_report_overall", "kfold_report_mean", "logo_breakdown",
            "logo_summary", "logo_report", "report_ymax", "oof_mean", "oof_linear", "logo_mean", "logo_linear",
            "fold_scale", "skew_profile", "median_fill",
            "layer_flops", "format_report", "clean_report", "oof_ridge", "manifest_bytes"}
# Queries compared at significant digits (see sig).
SIG_KEYS = {"fold_scale", "logo_ridge"}
_DIGITS = {"d": 6}


def r6(x: str) -> str:
    """Same comparison rounding as the Spark side: |x| < 1e4 to N places."""
    d = _DIGITS["d"]
    return f"CASE WHEN abs({x}) < 1e4 THEN round({x}, {d}) ELSE {x} END"


def _trials_cte() -> str:
    """raw trials + generator-derived columns (X20-X23), SQL side."""
    return f"""
raw AS ({RAW_TRIALS}),
trials AS (
  SELECT raw.*,
    prec_bits = 16 AS amp,
    param_count * 4 AS param_bytes,
    param_count * 4 * (CASE WHEN lower(optimizer) IN ('adam', 'adamw') THEN 2 ELSE 1 END)
      AS optimizer_state_bytes,
    CASE WHEN prec_bits = 16 THEN param_count * 4 ELSE 0 END AS master_param_bytes,
    param_count * 4 + param_count * 4 * (CASE WHEN lower(optimizer) IN ('adam', 'adamw') THEN 2 ELSE 1 END)
      + CASE WHEN prec_bits = 16 THEN param_count * 4 ELSE 0 END AS total_state_bytes,
    flops_fwd_per_sample * 3.0 AS flops_train_per_sample,
    flops_fwd_per_sample * 3.0 * CAST(batch_size AS DOUBLE) AS flops_train_per_batch,
    flops_fwd_per_sample * 3.0 / greatest(1.0, CAST(param_count * 4 AS DOUBLE)
      + CAST(act_bytes_per_sample_proxy AS DOUBLE)) AS arithmetic_intensity_train,
    CASE WHEN T_gpu_ms IS NULL THEN NULL WHEN T_cpu_io_ms IS NULL THEN T_gpu_ms
         ELSE greatest(T_gpu_ms, T_cpu_io_ms) END AS T_step_ms,
    CASE WHEN T_cpu_io_ms + T_gpu_ms > 0 THEN T_cpu_io_ms / (T_cpu_io_ms + T_gpu_ms) END AS loader_ratio,
    CASE WHEN T_gpu_ms > T_cpu_io_ms THEN 'gpu' ELSE 'host' END AS bottleneck
  FROM raw)"""


def _lfo_linear(src: str, fold: str, x: str, y_full: str = "avg_batch_time_ms",
                y_base: str = "T_gpu_ms") -> str:
    """Leave-fold-out simple regression coefficients for both targets."""
    def one(tag, y):
        return f"""
s_{tag} AS (
  SELECT {fold} AS fk,
    CAST(count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) AS DOUBLE) AS n,
    coalesce(sum(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} END), 0) AS sx,
    coalesce(sum(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {y} END), 0) AS sy,
    coalesce(sum(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} * {x} END), 0) AS sxx,
    coalesce(sum(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {x} * {y} END), 0) AS sxy,
    CAST(count({y}) AS DOUBLE) AS ny, coalesce(sum({y}), 0) AS sya
  FROM {src} GROUP BY {fold}),
t_{tag} AS (
  SELECT fk, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy,
         sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy,
         sum(ny) OVER () - ny AS ny, sum(sya) OVER () - sya AS sya
  FROM s_{tag}),
b_{tag} AS (
  SELECT fk, n,
    coalesce(CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END, 0.0) AS b,
    CASE WHEN ny <> 0 THEN sya / ny END AS ybar, sx, sy
  FROM t_{tag}),
c_{tag} AS (
  SELECT fk, n, b, ybar, CASE WHEN n > 0 THEN (sy - b * sx) / n ELSE ybar END AS a FROM b_{tag})"""
    return one("full", y_full) + "," + one("base", y_base)


def kfold_report_sql() -> str:
    return f"""
WITH {_trials_cte()},
d AS (SELECT *, log2(greatest(1.0, CAST(batch_size AS DOUBLE))) AS x FROM trials
      WHERE avg_batch_time_ms IS NOT NULL AND T_gpu_ms IS NOT NULL),
{_lfo_linear('d', 'fold', 'x')},
p AS (
  SELECT d.model, d.vcpu, d.storage, d.avg_batch_time_ms AS y,
    CASE WHEN d.x IS NOT NULL THEN cf.a + cf.b * d.x ELSE cf.ybar END AS pf,
    CASE WHEN d.x IS NOT NULL THEN cb.a + cb.b * d.x ELSE cb.ybar END AS pb
  FROM d JOIN c_full cf ON cf.fk = d.fold JOIN c_base cb ON cb.fk = d.fold),
r AS (
  SELECT coalesce(model, 'nan') AS model, vcpu, coalesce(storage, 'nan') AS storage,
    count(*) AS n_samples, sqrt(avg((y - pf) * (y - pf))) AS RMSE_full_ms,
    sqrt(avg((y - pb) * (y - pb))) AS RMSE_base_ms
  FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT model, vcpu, storage, n_samples, {r6('RMSE_full_ms')} AS RMSE_full_ms,
  {r6('RMSE_base_ms')} AS RMSE_base_ms,
  {r6('CASE WHEN RMSE_base_ms > 0 THEN 100.0 * (RMSE_base_ms - RMSE_full_ms) / RMSE_base_ms END')}
    AS Improvement_pct
FROM r ORDER BY model, vcpu, storage
"""



KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"






def _canon(c: str) -> str:
    return f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"


def _gmax(lo: str, c: str) -> str:
    """max(lo, c) keeping a missing c missing."""
    return f"(CASE WHEN {c} IS NOT NULL THEN greatest({lo}, {c}) END)"


def _contains_any(expr: str, keys) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{k}')" for k in keys) + ")"


def _arch_case(name: str) -> str:
    u = f"upper(coalesce({name}, 'nan'))"
    return f"""CASE
      WHEN {_contains_any(u, ('H100', 'H200'))} THEN 'Hopper'
      WHEN {_contains_any(u, ('L40S', 'L40', 'L4', 'RTX 4000', ' ADA'))}
           OR regexp_matches({u}, 'RTX\\s*5\\d{{3}}') THEN 'Ada'
      WHEN {_contains_any(u, ('A100', 'A40', 'A10'))} THEN 'Ampere'
      WHEN {_contains_any(u, ('V100', 'T4'))} THEN 'Turing'
      WHEN {_contains_any(u, ('P100', 'P4'))} THEN 'Pascal'
      ELSE 'Unknown' END"""


def _enriched_cte() -> str:
    return f"""{_trials_cte()},
spec AS ({GPU_SPEC}),
e AS (
  SELECT t.*, s.FP16, s.FP32, s.FP64, s.mem_gb, s.bw_gbs, s.SM, s.total_vram_bytes,
         s.mem_type, s.bus, s.gpu_arch
  FROM trials t LEFT JOIN spec s ON t.gpu_name = s.gpu_name
  WHERE t.avg_batch_time_ms IS NOT NULL AND t.T_gpu_ms IS NOT NULL)"""


def _features_cte(train: bool = False) -> str:
    """Enriched trials -> the whole CNN feature prefix.

    ``train``: every row's statistics come from the other folds' rows (``feat``),
    and ``feat_rest`` holds the training rows of every fold h with h's statistics."""
    B = "CAST(batch_size AS DOUBLE)"
    ampi = "CAST(coalesce(lower(CAST(amp AS VARCHAR)) IN ('true', '1', 'yes'), false) AS INTEGER)"
    lname = "lower(coalesce(gpu_name, 'nan'))"
    act = "CAST(act_bytes_per_sample_proxy AS DOUBLE)"
    roof_raw = f"""CASE WHEN tc IS NOT NULL AND tm IS NOT NULL THEN greatest(tc, tm) END"""
    tc = (f"flops_train_per_batch / greatest(1e-9, CASE WHEN {ampi} = 1 AND FP16 IS NOT NULL "
          f"THEN FP16 ELSE coalesce(FP32, 0.0) END) * 1000.0")
    tm = f"{act} * {B} / greatest(1.0, coalesce(bw_gbs * 1073741824.0, 0.0)) * 1000.0"
    onehots = []
    for col, cats in (("mem_type", ("GDDR7", "HBM2", "HBM2e", "nan")), ("bus", ("SXM2", "nan")),
                      ("gpu_arch", ("Ampere", "Blackwell", "Hopper", "Turing", "Volta", "nan")),
                      ("storage", ("SSD",))):
        for v in cats:
            onehots.append(f"CAST(coalesce({col}, 'nan') = '{v}' AS INTEGER) AS {col}_{v}")
    for v in ("Ampere", "Hopper", "Turing", "Unknown"):
        onehots.append(f"CAST(arch_family = '{v}' AS INTEGER) AS arch_{v}")
    tensor = ("a100", "a40", "a10", "l40", "l4", "h100", "rtx 50", "rtx 5090", "v100", "t4")
    dc = ("a100", "h100", "v100", "a40", "l40", "l4", "a10", "t4", "p100", "p4")
    return f"""{_enriched_cte()},
r0 AS (SELECT e.*, {_arch_case('gpu_name')} AS arch_family, {ampi} AS amp_i,
         {tc} AS tc, {tm} AS tm FROM e),
r1 AS (SELECT r0.*, {roof_raw} AS roof_raw FROM r0),
st AS (SELECT {'h, ' if train else ''}median(bw_gbs) AS med_bw, median(SM) AS med_sm, median(roof_raw) AS med_roof,
              count(total_vram_bytes) AS n_vram FROM {'(SELECT DISTINCT fold AS h FROM r1) JOIN r1 ON fold <> h GROUP BY h' if train else 'r1'}),
""" + ",\n".join(f"""
f1{end} AS (
  SELECT r1.*, med_bw, med_sm, med_roof, {'h, ' if train else ''}
    flops_train_per_batch / {_gmax('1e-9', 'bw_gbs')} AS flops_to_bw_ratio,
    flops_train_per_batch / {_gmax('1e-9', 'FP32')} AS flops_to_FP32_ratio,
    flops_train_per_batch / {_gmax('1e-9', 'FP16')} AS flops_to_FP16_ratio,
    flops_train_per_batch / {_gmax('1e-9', 'FP64')} AS flops_to_FP64_ratio,
    bw_gbs / {_gmax('1e-9', 'mem_gb')} AS bw_per_gb,
    arithmetic_intensity_train / {_gmax('1e-9', 'FP32')} AS ai_over_fp32,
    {", ".join(onehots)},
    CAST({_contains_any(lname, tensor)} AS INTEGER) AS has_tensor_cores,
    CAST(coalesce(regexp_matches(gpu_name, '(?i)PCIE|PCIe|PCI-E'), false) AS INTEGER) AS is_pcie,
    CAST(coalesce(regexp_matches(gpu_name, '(?i)SXM'), false) AS INTEGER) AS is_sxm,
    CAST({_contains_any(lname, dc)} AS INTEGER) AS is_datacenter,
    CAST(coalesce(regexp_matches(mem_type, '(?i)HBM'), false) AS INTEGER) AS has_HBM,
    FP16 / {_gmax('1e-9', 'flops_train_per_batch')} AS FP16_per_trainflop,
    FP32 / {_gmax('1e-9', 'flops_train_per_batch')} AS FP32_per_trainflop,
    flops_train_per_sample AS F_CNN_sample, flops_train_per_batch AS F_CNN_batch,
    ln(1 + flops_train_per_sample) AS log_F_CNN_sample, ln(1 + flops_train_per_batch) AS log_F_CNN_batch,
    log2(greatest(1.0, {B})) AS log2_batch_size,
    CAST({B} <= 32 AS INTEGER) AS batch_bin_small,
    CAST({B} > 32 AND {B} <= 128 AS INTEGER) AS batch_bin_medium,
    CAST({B} > 128 AS INTEGER) AS batch_bin_large,
    {B} / greatest(1.0, nullif(SM, 0.0)) AS B_per_SM,
    {B} / greatest(1.0, nullif(mem_gb, 0.0)) AS B_over_GB,
    {B} * coalesce(bw_gbs, med_bw, 0.0) AS B_times_BW,
    {B} * coalesce(SM, med_sm, 0.0) AS B_times_SM,
    (CAST(total_state_bytes AS DOUBLE) + {act} * {B}) / {_gmax('1.0', 'total_vram_bytes')} AS mem_pressure,
    amp_i AS amp_int,
    coalesce(roof_raw, med_roof) AS roof_time_ms
  FROM {src}),
f2{end} AS (
  SELECT f1{end}.*,
    CASE WHEN mem_pressure IS NOT NULL THEN least(1.0, greatest(0.0, 1.0 - mem_pressure)) END AS mem_headroom,
    CAST(coalesce(mem_pressure > 0.9, false) AS INTEGER) AS near_vram_limit,
    amp_i * has_tensor_cores AS tc_util_proxy
  FROM f1{end}),
feat{end} AS (
  SELECT f2{end}.*,
    {B} * tc_util_proxy AS B_times_tc, {B} * mem_headroom AS B_times_headroom,
    {B} * arch_Ampere AS B_times_arch_Ampere, {B} * 0 AS B_times_arch_Ada,
    {B} * arch_Hopper AS B_times_arch_Hopper
  FROM f2{end})""" for end, src in ((("", "r1 JOIN st ON r1.fold = st.h"), ("_rest", "r1 JOIN st ON r1.fold <> st.h")) if train else (("", "r1, st"),)))


def _round_cols(cols, doubles) -> str:
    return ", ".join(f"{r6(c)} AS {c}" if c in doubles else c for c in cols)


FEATURE_DOUBLES = {
    "flops_to_bw_ratio", "flops_to_FP32_ratio", "flops_to_FP16_ratio", "flops_to_FP64_ratio",
    "bw_per_gb", "ai_over_fp32", "FP16_per_trainflop", "FP32_per_trainflop", "mem_pressure",
    "mem_headroom", "log2_batch_size", "B_per_SM", "B_over_GB", "B_times_BW", "B_times_SM",
    "B_times_tc", "B_times_headroom", "B_times_arch_Ampere", "B_times_arch_Ada",
    "B_times_arch_Hopper", "roof_time_ms", "F_CNN_sample", "F_CNN_batch", "log_F_CNN_sample",
    "log_F_CNN_batch"}


def _feature_select(cols) -> str:
    sel = []
    for c in cols:
        if c == "amp":
            sel.append("amp_int AS amp")
        elif c in FEATURE_DOUBLES:
            sel.append(f"{r6(c)} AS {c}")
        else:
            sel.append(c)
    return f"WITH {_features_cte()}\nSELECT {KEYS}, {', '.join(sel)} FROM feat"


def _feature_group_sql(group: str):
    from .plans.catalog import FEATURE_GROUPS
    return lambda: _feature_select(FEATURE_GROUPS[group])


def scan_trials_sql() -> str:
    cols = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, gpu_name, model, dataset, architecture, "
            "vcpu, storage, batch_size, prec_bits, optimizer, learning_rate, param_count, "
            "flops_fwd_per_sample, act_bytes_per_sample_proxy, T_gpu_ms, T_cpu_io_ms, "
            "avg_batch_time_ms, fold, amp, param_bytes, optimizer_state_bytes, master_param_bytes, "
            "total_state_bytes, flops_train_per_sample, flops_train_per_batch, "
            "arithmetic_intensity_train, T_step_ms, loader_ratio, bottleneck")
    doubles = {"learning_rate", "flops_fwd_per_sample", "T_gpu_ms", "T_cpu_io_ms", "avg_batch_time_ms",
               "flops_train_per_sample", "flops_train_per_batch", "arithmetic_intensity_train",
               "T_step_ms", "loader_ratio"}
    return f"WITH {_trials_cte()}\nSELECT {_round_cols([c.strip() for c in cols.split(',')], doubles)} FROM trials"


def drop_missing_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, {r6('avg_batch_time_ms')} AS avg_batch_time_ms, {r6('T_gpu_ms')} AS T_gpu_ms
FROM trials WHERE avg_batch_time_ms IS NOT NULL AND T_gpu_ms IS NOT NULL
  AND NOT isnan(avg_batch_time_ms) AND NOT isnan(T_gpu_ms)"""


def canon_missing_sql() -> str:
    from .plans.catalog import CANON_SQL
    raw = fx.duckdb_view(CANON_SQL)
    return f"""WITH raw AS ({raw})
SELECT {KEYS}, {r6(_canon('loader_wait_ms'))} AS loader_wait_ms,
  {r6(_canon('compute_ms'))} AS compute_ms FROM raw"""


def gpu_slug_sql() -> str:
    s = "regexp_replace(url, '[<>:\"/\\\\|?*\\x00-\\x1F]', '_', 'g')"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', '_', 'g')"
    return f"SELECT page_id, substring({s}, 1, 140) AS slug FROM pages"


def trial_enrich_sql() -> str:
    return f"""WITH {_trials_cte()}, spec AS ({GPU_SPEC})
SELECT {KEYS}, t.gpu_name, batch_size, FP16, FP32, FP64, mem_gb, bw_gbs, SM, total_vram_bytes,
  mem_type, bus, gpu_arch
FROM trials t LEFT JOIN spec s ON t.gpu_name = s.gpu_name"""


def union_trials_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, gpu_name, {r6('T_gpu_ms')} AS T_gpu_ms, {r6('T_cpu_io_ms')} AS T_cpu_io_ms,
  CAST(NULL AS DOUBLE) AS avg_batch_time_ms FROM trials WHERE l_suppkey % 2 = 0
UNION ALL
SELECT {KEYS}, gpu_name, {r6('T_gpu_ms')}, CAST(NULL AS DOUBLE), {r6('avg_batch_time_ms')}
FROM trials WHERE l_suppkey % 2 = 1"""


def gpu_arch_sql() -> str:
    return f"""WITH {_features_cte()}
SELECT gpu_name, arch_family, count(*) AS n_trials FROM feat GROUP BY 1, 2"""


def gpu_flags_sql() -> str:
    return f"""WITH {_features_cte()}
SELECT gpu_name, has_tensor_cores, is_pcie, is_sxm, is_datacenter, has_HBM, count(*) AS n_trials
FROM feat GROUP BY ALL"""


def median_fill_sql() -> str:
    return f"""WITH {_features_cte()}
SELECT {r6('med_bw')} AS med_bw, {r6('med_sm')} AS med_sm, {r6('med_roof')} AS med_roof,
  n_vram FROM st"""


# Candidate columns of the heavy-tail profile on the fixture (numeric
# columns minus target, leaky and key columns), in schema order.
SKEW_CANDIDATES = (
    "vcpu", "batch_size", "prec_bits", "learning_rate", "param_count", "flops_fwd_per_sample",
    "act_bytes_per_sample_proxy", "amp", "param_bytes", "optimizer_state_bytes",
    "master_param_bytes", "total_state_bytes", "flops_train_per_sample", "flops_train_per_batch",
    "arithmetic_intensity_train", "FP16", "FP32", "FP64", "mem_gb", "bw_gbs", "SM",
    "total_vram_bytes", "flops_to_bw_ratio", "flops_to_FP32_ratio", "flops_to_FP16_ratio",
    "flops_to_FP64_ratio", "bw_per_gb", "ai_over_fp32", "mem_type_GDDR7", "mem_type_HBM2",
    "mem_type_HBM2e", "mem_type_nan", "bus_SXM2", "bus_nan", "gpu_arch_Ampere",
    "gpu_arch_Blackwell", "gpu_arch_Hopper", "gpu_arch_Turing", "gpu_arch_Volta", "gpu_arch_nan",
    "storage_SSD", "arch_Ampere", "arch_Hopper", "arch_Turing", "arch_Unknown",
    "has_tensor_cores", "is_pcie", "is_sxm", "is_datacenter", "has_HBM", "FP16_per_trainflop",
    "FP32_per_trainflop", "F_CNN_sample", "F_CNN_batch", "log_F_CNN_sample", "log_F_CNN_batch",
    "log2_batch_size", "batch_bin_small", "batch_bin_medium", "batch_bin_large", "B_per_SM",
    "B_over_GB", "B_times_BW", "B_times_SM", "mem_pressure", "roof_time_ms", "mem_headroom",
    "near_vram_limit", "tc_util_proxy", "B_times_tc", "B_times_headroom", "B_times_arch_Ampere",
    "B_times_arch_Ada", "B_times_arch_Hopper")


def _prof_expr(c: str) -> str:
    x = "CAST(amp_int AS DOUBLE)" if c == "amp" else f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, count({x}) AS n, count(*) - count({x}) AS n_missing,
  count(CASE WHEN {x} NOT IN (0.0, 1.0) THEN 1 END) AS n_non01,
  coalesce(bool_or({x} < 0), false) AS has_negative,
  CASE WHEN count({x}) >= 3 AND NOT isnan(skewness({x})) THEN skewness({x}) END AS skew FROM feat"""


def skew_profile_sql() -> str:
    parts = "\nUNION ALL\n".join(_prof_expr(c) for c in SKEW_CANDIDATES)
    return f"""WITH {_features_cte()}, prof AS ({parts})
SELECT column_name AS "column", n, n_missing, n_non01, has_negative, {r6('skew')} AS skew,
  (NOT has_negative) AND NOT (n_non01 = 0 AND n_missing = 0) AND coalesce(skew > 1.0, false) AS take_log
FROM prof"""


# Heavy-tailed columns the profile selects on the fixture (checked by the
# skew_profile oracle above).
LOG1P_COLUMNS = (
    "flops_train_per_batch", "FP16", "FP64", "flops_to_bw_ratio", "flops_to_FP32_ratio",
    "flops_to_FP16_ratio", "flops_to_FP64_ratio", "bw_per_gb", "ai_over_fp32",
    "FP16_per_trainflop", "FP32_per_trainflop", "F_CNN_batch", "B_per_SM", "B_over_GB",
    "B_times_BW", "B_times_SM", "mem_pressure", "roof_time_ms", "B_times_tc",
    "B_times_arch_Ampere", "B_times_arch_Hopper")


def log1p_features_sql() -> str:
    sel = ", ".join(f"{r6(f'ln(1 + CAST({c} AS DOUBLE))')} AS log1p__{c}" for c in LOG1P_COLUMNS)
    return f"WITH {_features_cte()}\nSELECT {KEYS}{', ' + sel if sel else ''} FROM feat"


STEPS = fx.duckdb_view(fx.STEPS_SQL)
LAYERS = fx.duckdb_view(fx.LAYERS_SQL)


def _measured_cte() -> str:
    return f"""steps AS ({STEPS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY ts, event_id) AS rn FROM steps),
m AS (SELECT *, CASE WHEN NOT coalesce(oom, false) THEN loader_ms + compute_ms END AS total,
             NOT coalesce(oom, false) AS ok
      FROM ranked WHERE rn > 5 AND rn <= 25)"""


def trial_timing_sql(floor: str | None = None) -> str:
    if floor is None:
        ratio = "CASE WHEN avg_loader_ms + avg_compute_ms > 0 THEN avg_loader_ms / (avg_loader_ms + avg_compute_ms) END"
    else:
        ratio = f"avg_loader_ms / greatest({floor}, avg_loader_ms + avg_compute_ms)"
    return f"""WITH {_measured_cte()},
r AS (SELECT trial_id, count(total) AS n_steps, avg(total) AS avg_batch_time_ms,
        quantile_cont(total, 0.9) AS p90_batch_time_ms,
        avg(CASE WHEN ok THEN loader_ms END) AS avg_loader_ms,
        avg(CASE WHEN ok THEN compute_ms END) AS avg_compute_ms
      FROM m GROUP BY trial_id)
SELECT trial_id, n_steps, {r6('avg_batch_time_ms')} AS avg_batch_time_ms,
  {r6('p90_batch_time_ms')} AS p90_batch_time_ms, {r6('avg_loader_ms')} AS avg_loader_ms,
  {r6('avg_compute_ms')} AS avg_compute_ms, {r6('avg_compute_ms')} AS T_gpu_ms,
  {r6('avg_loader_ms')} AS T_cpu_io_ms,
  {r6('CASE WHEN avg_compute_ms IS NULL THEN NULL WHEN avg_loader_ms IS NULL THEN avg_compute_ms ELSE greatest(avg_compute_ms, avg_loader_ms) END')} AS T_step_ms,
  {r6(ratio)} AS loader_ratio,
  CASE WHEN avg_compute_ms > avg_loader_ms THEN 'gpu' ELSE 'host' END AS bottleneck
FROM r"""


def stream_window_sql() -> str:
    return f"""WITH steps AS ({STEPS}),
t AS (SELECT trial_id, date_trunc('day', ts) AS d, CASE WHEN NOT coalesce(oom, false) THEN loader_ms + compute_ms END AS x FROM steps)
SELECT strftime(d, '%Y-%m-%d') AS window_start, count(trial_id) AS n_steps, {r6('avg(x)')} AS avg_step_ms, {r6('quantile_disc(x, 0.9)')} AS p90_step_ms
FROM t GROUP BY d"""


def trial_throughput_sql() -> str:
    return f"""WITH {_measured_cte()},
r AS (SELECT trial_id, sum(compute_ms) / 1000.0 AS secs,
        CAST(sum(CASE WHEN fwd_done THEN n_examples ELSE 0 END) AS BIGINT) AS n_examples,
        CAST(sum(CASE WHEN fwd_done THEN n_tokens ELSE 0 END) AS BIGINT) AS n_tokens
      FROM m GROUP BY trial_id)
SELECT trial_id, n_examples, n_tokens,
  {r6('CASE WHEN secs > 0 THEN n_examples / secs END')} AS examples_per_sec,
  {r6('CASE WHEN secs > 0 AND n_tokens > 0 THEN n_tokens / secs END')} AS tokens_per_sec
FROM r"""


def layer_flops_sql() -> str:
    fconv = ("2.0 * (CAST(c_in AS DOUBLE) / CAST(greatest(1, groups) AS DOUBLE)) * CAST(c_out AS DOUBLE)"
             " * CAST(kh AS DOUBLE) * CAST(kw AS DOUBLE) * CAST(h_out AS DOUBLE) * CAST(w_out AS DOUBLE)")
    dw = "(kind = 'conv' AND greatest(1, groups) = c_in AND c_out = c_in)"
    grp = f"(kind = 'conv' AND NOT {dw} AND greatest(1, groups) > 1)"
    plain = f"(kind = 'conv' AND NOT {dw} AND greatest(1, groups) <= 1)"
    hwc = "CAST(h_out AS BIGINT) * w_out * c_out"
    return f"""WITH layers AS ({LAYERS}),
r AS (SELECT model,
  sum(CASE WHEN kind = 'conv' THEN {fconv} WHEN kind = 'linear'
      THEN 2.0 * CAST(in_features AS DOUBLE) * CAST(out_features AS DOUBLE) ELSE 0.0 END) AS tot,
  sum(CASE WHEN {plain} AND kh = 1 AND kw = 1 THEN {fconv} ELSE 0.0 END) AS f1,
  sum(CASE WHEN {plain} AND kh = 3 AND kw = 3 THEN {fconv} ELSE 0.0 END) AS f3,
  sum(CASE WHEN {dw} THEN {fconv} ELSE 0.0 END) AS fd,
  sum(CASE WHEN {dw} OR {grp} THEN {fconv} ELSE 0.0 END) AS fg,
  CAST(coalesce(sum(CASE WHEN kind = 'conv' THEN {hwc} END), 0) AS BIGINT) AS sum_hwC,
  CAST(coalesce(max(CASE WHEN kind = 'conv' THEN {hwc} END), 0) AS BIGINT) AS max_hwC,
  count(CASE WHEN kind = 'bn' THEN 1 END) AS bn_layers,
  count(CASE WHEN kind = 'act' THEN 1 END) AS act_layers,
  CAST(sum(act_scalars) AS BIGINT) AS act_scalars, CAST(sum(n_params) AS BIGINT) AS param_count,
  count(CASE WHEN kind IN ('conv', 'linear') THEN 1 END) AS depth
FROM layers GROUP BY model)
SELECT model, tot AS flops_fwd_per_sample,
  {r6('f1 / CASE WHEN tot > 0 THEN tot ELSE 1.0 END')} AS flops_1x1_frac,
  {r6('f3 / CASE WHEN tot > 0 THEN tot ELSE 1.0 END')} AS flops_3x3_frac,
  {r6('fd / CASE WHEN tot > 0 THEN tot ELSE 1.0 END')} AS flops_depthwise_frac,
  {r6('fg / CASE WHEN tot > 0 THEN tot ELSE 1.0 END')} AS flops_grouped_frac,
  act_scalars, sum_hwC, max_hwC, bn_layers, act_layers, param_count, depth
FROM r"""


def _hosts_cte() -> str:
    return f"""{_trials_cte()},
hosts AS (SELECT gpu_name, storage, greatest(1, max(vcpu)) AS vcpu_cap FROM trials GROUP BY 1, 2),
hw AS (SELECT gpu_name, storage, vcpu_cap, CAST(greatest(0, least(w, vcpu_cap)) AS BIGINT) AS vcpu
       FROM hosts, unnest([4, 8, 16]) AS u(w))"""


def _values(rows, cols, alias: str = "v") -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")"
                     for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


def grid_trials_sql() -> str:
    from .operators import grid as g
    allowed = [p for p in g.CNN_ALLOWED if p[0] in g.CNN_MODELS and p[1] in g.CNN_DATASETS]
    return f"""WITH {_hosts_cte()}
SELECT hw.gpu_name, hw.storage, hw.vcpu_cap, p.model, p.dataset, o.optimizer,
  CAST(l.learning_rate AS DOUBLE) AS learning_rate, b.batch_size, pr.prec_bits, hw.vcpu,
  'CNN' AS architecture
FROM hw, {_values(allowed, ('model', 'dataset'), 'p')},
  unnest(['SGD', 'AdamW']) AS o(optimizer), unnest([0.0005, 0.001, 0.002]::DOUBLE[]) AS l(learning_rate),
  unnest([32, 64, 128, 256]::BIGINT[]) AS b(batch_size), unnest([16, 32]) AS pr(prec_bits)"""


def flops_mlp_sql() -> str:
    from .operators import grid as g
    B = "CAST(batch_size AS DOUBLE)"
    return f"""WITH {_hosts_cte()},
base AS (
  SELECT hw.gpu_name, hw.storage, hw.vcpu, p.model, p.dataset, e.embed_dim,
    4 * e.embed_dim AS channel_mlp_dim, greatest(128, e.embed_dim // 2) AS token_mlp_dim,
    CASE WHEN p.dataset = 'TinyImageNet' THEN (CASE WHEN p.model = 'mixer' THEN 10 ELSE 12 END)
         ELSE (CASE WHEN p.model = 'mixer' THEN 8 ELSE 12 END) END AS depth,
    CASE p.dataset WHEN 'CIFAR100' THEN 32 WHEN 'TinyImageNet' THEN 64 ELSE 96 END AS image_size,
    CASE WHEN p.dataset = 'CIFAR100' AND p.model = 'asmlp' THEN 4 ELSE 8 END AS patch_size,
    l.learning_rate, b.batch_size, o.optimizer, pr.prec_bits
  FROM hw, {_values(g.MLP_ALLOWED, ('model', 'dataset'), 'p')}, unnest([128, 256]) AS e(embed_dim),
    unnest([0.0005, 0.001, 0.002]::DOUBLE[]) AS l(learning_rate),
    unnest([32, 128, 256]::BIGINT[]) AS b(batch_size), unnest(['AdamW', 'SGD']) AS o(optimizer),
    unnest([16, 32]) AS pr(prec_bits)),
q AS (SELECT *, pow(floor(CAST(image_size AS DOUBLE) / CAST(patch_size AS DOUBLE)), 2) AS P,
        CAST(embed_dim AS DOUBLE) AS D FROM base),
f AS (SELECT *,
  P * (2.0 * (3.0 * CAST(patch_size AS DOUBLE) * CAST(patch_size AS DOUBLE)) * D)
  + CAST(depth AS DOUBLE) * (CASE model
      WHEN 'mixer' THEN 4.0 * D * P * CAST(token_mlp_dim AS DOUBLE) + 4.0 * P * D * CAST(channel_mlp_dim AS DOUBLE) + 4.0 * P * D
      WHEN 'resmlp' THEN 2.0 * D * P * P + 4.0 * P * D * CAST(channel_mlp_dim AS DOUBLE) + 4.0 * P * D
      ELSE P * (4.0 * D * D) + 4.0 * P * D * CAST(channel_mlp_dim AS DOUBLE) + 4.0 * P * D END) AS fwd
  FROM q)
SELECT gpu_name, storage, vcpu, model, dataset, embed_dim, learning_rate, batch_size, optimizer,
  prec_bits, depth, patch_size, CAST(P AS BIGINT) AS num_patches, fwd AS flops_fwd_per_sample,
  fwd * 3.0 * {B} AS flops_train_per_batch,
  CAST(P AS BIGINT) * embed_dim * (CASE WHEN prec_bits = 16 THEN 2 ELSE 4 END) * depth
    AS act_bytes_per_sample_proxy
FROM f"""


def _transformer_cte() -> str:
    from .operators import grid as g
    rows = []
    for m, d, task, bs, lrs, opts, L in g.TRANSFORMER_SWEEPS:
        dm, nh, ff, dep = g.TRANSFORMER_DIMS[m]
        rows.append(f"('{m}', '{d}', '{task}', {L}, {dm}, {nh}, {ff}, {dep}, "
                    f"{list(bs)}::BIGINT[], {list(lrs)}::DOUBLE[], {list(opts)})")
    sweeps = ("(VALUES " + ", ".join(rows) + ") AS s(model, dataset, task, cfg_len, d_model, n_heads, "
              "d_ff, depth, batches, lrs, opts)")
    blk = ("4.0 * CAST(d_model AS DOUBLE) * CAST(d_model AS DOUBLE) + 2.0 * CAST(cfg_len AS DOUBLE) * "
           "CAST(d_model AS DOUBLE) * greatest(1.0, floor(CAST(d_model AS DOUBLE) / CAST(n_heads AS DOUBLE)))"
           " + 2.0 * CAST(d_model AS DOUBLE) * CAST(d_ff AS DOUBLE)")
    return f"""WITH {_hosts_cte()},
x AS (
  SELECT hw.gpu_name, hw.storage, hw.vcpu, s.*, o.optimizer, l.learning_rate, b.batch_size, pr.prec_bits
  FROM hw, {sweeps}, unnest(s.opts) AS o(optimizer), unnest(s.lrs) AS l(learning_rate),
    unnest(s.batches) AS b(batch_size), unnest([16, 32]) AS pr(prec_bits)),
y AS (SELECT *, {blk} AS blk FROM x)"""


def flops_transformer_sql() -> str:
    return _transformer_cte() + """
SELECT gpu_name, storage, vcpu, model, dataset, task, optimizer, learning_rate, batch_size, prec_bits,
  CASE WHEN task <> 'seq2seq' THEN CAST(cfg_len AS DOUBLE) END AS seq_len,
  CAST(cfg_len AS DOUBLE) AS src_len,
  CASE WHEN task = 'seq2seq' THEN CAST(cfg_len AS DOUBLE) END AS tgt_len,
  CAST(floor(d_model / n_heads) AS BIGINT) AS d_head,
  blk AS flops_fwd_per_token,
  blk * CAST(cfg_len AS DOUBLE) * CAST(depth AS DOUBLE) * 3.0 AS flops_train_per_seq,
  blk * CAST(cfg_len AS DOUBLE) * CAST(depth AS DOUBLE) * 3.0 * CAST(batch_size AS DOUBLE)
    AS flops_train_per_batch,
  CAST(cfg_len AS BIGINT) * (d_model + d_ff) * (CASE WHEN prec_bits = 16 THEN 2 ELSE 4 END)
    AS act_bytes_per_seq_proxy
FROM y"""


def mem_estimate_tr_sql() -> str:
    return _transformer_cte() + """,
z AS (SELECT *, CAST(depth AS BIGINT) * (4 * CAST(d_model AS BIGINT) * d_model + 2 * CAST(d_model AS BIGINT) * d_ff) * 4 AS pb,
        CASE WHEN lower(optimizer) IN ('adam', 'adamw', 'adafactor') THEN 2 ELSE 1 END AS mult FROM y)
SELECT gpu_name, CASE WHEN storage IS NULL OR upper(storage) = 'NVME' THEN 'NVME' ELSE 'SSD' END AS storage, vcpu, model,
  dataset, optimizer, learning_rate, batch_size, prec_bits, pb AS param_bytes, pb * mult AS optimizer_state_bytes,
  CASE WHEN prec_bits = 16 THEN pb ELSE 0 END AS master_param_bytes,
  pb + pb * mult + CASE WHEN prec_bits = 16 THEN pb ELSE 0 END AS total_state_bytes
FROM z"""


def mem_estimate_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, param_bytes, optimizer_state_bytes, master_param_bytes, total_state_bytes,
  act_bytes_per_sample_proxy, {r6('arithmetic_intensity_train')} AS arithmetic_intensity_train
FROM trials"""


def trial_timing_cols_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, {r6('T_step_ms')} AS T_step_ms, {r6('loader_ratio')} AS loader_ratio, bottleneck
FROM trials"""


def kfold_assign_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, ('0x' || substr(md5(concat_ws('|', '42', CAST(l_orderkey AS VARCHAR),
  CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), 1, 8))::BIGINT % 5
  AS fold_md5
FROM trials"""


def _even_fold(name: str = "fold", ties: str = "") -> str:
    key = "concat_ws('|', '42', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))"
    return f"CAST((row_number() OVER (ORDER BY md5({key}), {KEYS}{ties}) - 1) % 5 AS BIGINT) AS {name}"


def kfold_even_sql() -> str:
    return f"WITH {_trials_cte()}\nSELECT {KEYS}, {_even_fold('fold_even')} FROM trials"


def kfold_report_even_sql() -> str:
    sql = kfold_report_sql()
    return sql.replace("d AS (SELECT *, log2(", 
                       "d AS (SELECT * EXCLUDE (fold), " + _even_fold(ties=", avg_batch_time_ms, T_gpu_ms, model, vcpu, storage, batch_size") + ", log2(", 1)


def _eval_cte() -> str:
    return f"""{_trials_cte()},
d AS (SELECT *, log2(greatest(1.0, CAST(batch_size AS DOUBLE))) AS x FROM trials
      WHERE avg_batch_time_ms IS NOT NULL AND T_gpu_ms IS NOT NULL)"""


def oof_mean_sql() -> str:
    return f"""WITH {_eval_cte()},
g AS (SELECT fold, model, vcpu, storage, batch_size, sum(avg_batch_time_ms) AS s,
        count(avg_batch_time_ms) AS n FROM d GROUP BY ALL),
t AS (SELECT *, sum(s) OVER (PARTITION BY model, vcpu, storage, batch_size) - s AS ts,
        sum(n) OVER (PARTITION BY model, vcpu, storage, batch_size) - n AS tn FROM g),
f AS (SELECT fold, sum(avg_batch_time_ms) AS s0, count(avg_batch_time_ms) AS n0 FROM d GROUP BY fold),
ft AS (SELECT fold, sum(s0) OVER () - s0 AS ts0, sum(n0) OVER () - n0 AS tn0 FROM f)
SELECT t.fold, model, vcpu, storage, batch_size,
  {r6('CASE WHEN tn > 0 THEN ts / tn WHEN tn0 <> 0 THEN ts0 / tn0 END')} AS pred_full,
  CAST(tn AS BIGINT) AS pred_full_train_rows
FROM t JOIN ft ON t.fold = ft.fold"""


def oof_linear_sql() -> str:
    return f"""WITH {_eval_cte()},
{_lfo_linear('d', 'fold', 'x')}
SELECT cf.fk AS fold, {r6('cf.a')} AS pred_full_a, {r6('cf.b')} AS pred_full_b,
  {r6('cf.ybar')} AS pred_full_ybar, CAST(cf.n AS BIGINT) AS pred_full_train_rows,
  {r6('cb.a')} AS pred_base_a, {r6('cb.b')} AS pred_base_b, {r6('cb.ybar')} AS pred_base_ybar,
  CAST(cb.n AS BIGINT) AS pred_base_train_rows
FROM c_full cf JOIN c_base cb ON cf.fk = cb.fk"""


def _logo_pred_cte() -> str:
    return f"""{_eval_cte()},
{_lfo_linear('d', 'gpu_name', 'x')},
held AS (SELECT gpu_name FROM d WHERE gpu_name IS NOT NULL GROUP BY gpu_name HAVING count(*) >= 3),
p AS (
  SELECT d.gpu_name, d.model, d.vcpu, d.storage, d.batch_size, d.avg_batch_time_ms AS y,
    CASE WHEN d.x IS NOT NULL THEN cf.a + cf.b * d.x ELSE cf.ybar END AS pf,
    CASE WHEN d.x IS NOT NULL THEN cb.a + cb.b * d.x ELSE cb.ybar END AS pb
  FROM d JOIN c_full cf ON cf.fk = d.gpu_name JOIN c_base cb ON cb.fk = d.gpu_name
  WHERE d.gpu_name IN (SELECT gpu_name FROM held))"""


def logo_mean_sql() -> str:
    return f"""WITH {_eval_cte()},
g AS (SELECT gpu_name, model, batch_size, sum(T_gpu_ms) AS s, count(T_gpu_ms) AS n FROM d GROUP BY ALL),
t AS (SELECT *, sum(s) OVER (PARTITION BY model, batch_size) - s AS ts,
        sum(n) OVER (PARTITION BY model, batch_size) - n AS tn FROM g),
f AS (SELECT gpu_name, sum(T_gpu_ms) AS s0, count(T_gpu_ms) AS n0 FROM d GROUP BY gpu_name),
ft AS (SELECT gpu_name, sum(s0) OVER () - s0 AS ts0, sum(n0) OVER () - n0 AS tn0 FROM f)
SELECT t.gpu_name, model, batch_size,
  {r6('CASE WHEN tn > 0 THEN ts / tn WHEN tn0 <> 0 THEN ts0 / tn0 END')} AS pred_base,
  CAST(tn AS BIGINT) AS pred_base_train_rows
FROM t JOIN ft ON t.gpu_name = ft.gpu_name"""


def logo_linear_sql() -> str:
    return f"""WITH {_eval_cte()},
{_lfo_linear('d', 'gpu_name', 'x')},
held AS (SELECT gpu_name FROM d WHERE gpu_name IS NOT NULL GROUP BY gpu_name HAVING count(*) >= 3)
SELECT cf.fk AS gpu_name, {r6('cf.a')} AS pred_full_a, {r6('cf.b')} AS pred_full_b,
  {r6('cf.ybar')} AS pred_full_ybar, CAST(cf.n AS BIGINT) AS pred_full_train_rows,
  {r6('cb.a')} AS pred_base_a, {r6('cb.b')} AS pred_base_b, {r6('cb.ybar')} AS pred_base_ybar,
  CAST(cb.n AS BIGINT) AS pred_base_train_rows
FROM c_full cf JOIN c_base cb ON cf.fk = cb.fk WHERE cf.fk IN (SELECT gpu_name FROM held)"""


def _group_stats(keys: str) -> str:
    return f"""count(*) AS n_samples, avg(y) AS am, avg(pf) AS pfm, avg(pb) AS pbm,
    sqrt(avg((y - pf) * (y - pf))) AS rf, sqrt(avg((y - pb) * (y - pb))) AS rb"""


def logo_breakdown_sql() -> str:
    parts = []
    for label, key in (("vcpu", "vcpu"), ("storage", "storage"), ("batch", "batch_size")):
        parts.append(f"""SELECT '{label}' AS breakdown, gpu_name, model, CAST({key} AS VARCHAR) AS group_value,
    {_group_stats(key)}
  FROM p WHERE model IS NOT NULL AND {key} IS NOT NULL GROUP BY gpu_name, model, {key}""")
    u = "\nUNION ALL\n".join(parts)
    return f"""WITH {_logo_pred_cte()},
b AS ({u})
SELECT breakdown, gpu_name, model, group_value, n_samples, {r6('am')} AS Actual_ms_mean,
  {r6('pfm')} AS Pred_full_ms_mean, {r6('CASE WHEN am <> 0 THEN 100.0 * (pfm - am) / am END')} AS full_pct_error,
  {r6('rf')} AS RMSE_full_ms, {r6('pbm')} AS Pred_base_ms_mean,
  {r6('CASE WHEN am <> 0 THEN 100.0 * (pbm - am) / am END')} AS base_pct_error, {r6('rb')} AS RMSE_base_ms
FROM b"""


def logo_summary_sql() -> str:
    return f"""WITH {_logo_pred_cte()},
s AS (SELECT gpu_name, {_group_stats('gpu_name')} FROM p GROUP BY gpu_name)
SELECT gpu_name AS GPU, n_samples, {r6('rf')} AS RMSE_full_ms, {r6('rb')} AS RMSE_base_ms,
  {r6('CASE WHEN rb > 0 THEN 100.0 * (rb - rf) / rb END')} AS Improvement_pct
FROM s ORDER BY rf"""


def logo_report_sql() -> str:
    b = logo_breakdown_sql()
    sm = logo_summary_sql().replace(" ORDER BY rf", "")
    return f"""WITH b AS ({b}), s AS ({sm})
SELECT b.*, s.n_samples AS gpu_n_samples, s.RMSE_full_ms AS gpu_RMSE_full_ms,
  s.RMSE_base_ms AS gpu_RMSE_base_ms, s.Improvement_pct AS gpu_Improvement_pct
FROM b JOIN s ON b.gpu_name = s.GPU"""


def report_ymax_sql() -> str:
    return f"""WITH {_logo_pred_cte()},
s AS (SELECT gpu_name, {_group_stats('gpu_name')} FROM p GROUP BY gpu_name)
SELECT {r6('max(greatest(rf, rb))')} AS ymax FROM s"""


def _kfold_variant(keys: str, predictor: str) -> str:
    if predictor == "linear":
        pred = f"""{_lfo_linear('d', 'fold', 'x')},
p AS (
  SELECT d.model, d.vcpu, d.storage, d.avg_batch_time_ms AS y,
    CASE WHEN d.x IS NOT NULL THEN cf.a + cf.b * d.x ELSE cf.ybar END AS pf,
    CASE WHEN d.x IS NOT NULL THEN cb.a + cb.b * d.x ELSE cb.ybar END AS pb
  FROM d JOIN c_full cf ON cf.fk = d.fold JOIN c_base cb ON cb.fk = d.fold)"""
    else:
        def lfo(tag, y, groups):
            return f"""g_{tag} AS (SELECT fold, {groups}, sum({y}) AS s, count({y}) AS n FROM d GROUP BY ALL),
t_{tag} AS (SELECT *, sum(s) OVER (PARTITION BY {groups}) - s AS ts,
          sum(n) OVER (PARTITION BY {groups}) - n AS tn FROM g_{tag}),
f_{tag} AS (SELECT fold, sum({y}) AS s0, count({y}) AS n0 FROM d GROUP BY fold),
ft_{tag} AS (SELECT fold, sum(s0) OVER () - s0 AS ts0, sum(n0) OVER () - n0 AS tn0 FROM f_{tag}),
m_{tag} AS (SELECT t.fold, {', '.join('t.' + g.strip() for g in groups.split(','))},
          CASE WHEN tn > 0 THEN ts / tn WHEN tn0 <> 0 THEN ts0 / tn0 END AS pred
        FROM t_{tag} t JOIN ft_{tag} ft ON t.fold = ft.fold)"""
        fg, bg = "model, vcpu, storage, batch_size", "model, batch_size"
        pred = f"""{lfo('f', 'avg_batch_time_ms', fg)},
{lfo('b', 'T_gpu_ms', bg)},
p AS (
  SELECT d.model, d.vcpu, d.storage, d.avg_batch_time_ms AS y, mf.pred AS pf, mb.pred AS pb
  FROM d JOIN m_f mf ON mf.fold = d.fold AND mf.model = d.model AND mf.vcpu = d.vcpu
    AND mf.storage = d.storage AND mf.batch_size = d.batch_size
  JOIN m_b mb ON mb.fold = d.fold AND mb.model = d.model AND mb.batch_size = d.batch_size)"""
    sel_keys = ", ".join(f"coalesce({k}, 'nan') AS {k}" if k in ("model", "storage") else k
                         for k in [k.strip() for k in keys.split(",")])
    return f"""WITH {_eval_cte()},
{pred},
r AS (SELECT {sel_keys}, count(*) AS n_samples, sqrt(avg((y - pf) * (y - pf))) AS rf,
        sqrt(avg((y - pb) * (y - pb))) AS rb
      FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT {keys}, n_samples, {r6('rf')} AS RMSE_full_ms, {r6('rb')} AS RMSE_base_ms,
  {r6('CASE WHEN rb > 0 THEN 100.0 * (rb - rf) / rb END')} AS Improvement_pct
FROM r"""


def kfold_report_overall_sql() -> str:
    return _kfold_variant("model", "linear")


def kfold_report_mean_sql() -> str:
    return _kfold_variant("model, vcpu, storage", "mean")


def format_report_sql() -> str:
    inner = _kfold_variant("model, vcpu, storage", "linear")
    def f(c):
        return f"coalesce(printf('%.2f', round({c}, 2)), 'nan') AS {c}"
    return f"""WITH q AS ({inner})
SELECT model, vcpu, storage, {f('RMSE_full_ms')}, {f('RMSE_base_ms')}, {f('Improvement_pct')} FROM q"""


def matrix_columns() -> list[tuple[str, str]]:
    """(name, SQL) of every feature of the full matrix, in its order."""
    return ([(c, f"CAST({'amp_int' if c == 'amp' else c} AS DOUBLE)") for c in MATRIX_FEATURES]
            + [(f"log1p__{c}", _log1p(f"CAST({c} AS DOUBLE)")) for c in LOG1P_COLUMNS])


def _log1p(x: str) -> str:
    """ln(1 + x) to full precision for small x (DuckDB has no log1p)."""
    return f"CASE WHEN 1.0 + {x} = 1.0 THEN {x} ELSE ln(1.0 + {x}) * ({x} / ((1.0 + {x}) - 1.0)) END"


def _mx_cte() -> str:
    """The matrix with features f0, f1, ... beside keys, folds and targets."""
    cols = ", ".join(f"{x} AS f{i}" for i, (_, x) in enumerate(matrix_columns()))
    return f"""{_features_cte()},
mx AS (SELECT {KEYS}, fold, gpu_name, model, vcpu, storage, avg_batch_time_ms AS yf, T_gpu_ms AS yb, {cols} FROM feat)"""


def _meds_cte(fold: str) -> str:
    meds = ", ".join(f"median(f{i}) AS d{i}" for i in range(len(matrix_columns())))
    return f"""held AS (SELECT {fold} AS h, count(*) AS rows_h FROM mx WHERE {fold} IS NOT NULL GROUP BY 1),
med AS (SELECT h, {meds} FROM held JOIN mx ON mx.{fold} IS DISTINCT FROM h GROUP BY h)"""


def sig(x: str, digits: int = 8) -> str:
    """Rounded to significant digits: sums of large values differ in the last bits between engines."""
    e = f"floor(log10(abs({x})))"
    return (f"CASE WHEN {x} = 0 THEN {x} ELSE CAST(CAST(round({x} / pow(10.0, {e}), {digits}) AS VARCHAR) || 'e' "
            f"|| CAST(CAST({e} AS INTEGER) AS VARCHAR) AS DOUBLE) END")


def fold_impute_sql() -> str:
    sel = ", ".join(f"{r6(f'd{i}')} AS med__{c}" for i, (c, _) in enumerate(matrix_columns()))
    return f"""WITH {_mx_cte()},
{_meds_cte('gpu_name')}
SELECT h AS gpu_name, {sel} FROM med"""


def _moments_cte() -> str:
    cols = ", ".join(f"avg(f{i}) AS m{i}, coalesce(nullif(stddev_pop(f{i}), 0), 1.0) AS s{i}" for i in range(len(matrix_columns())))
    return f"""held AS (SELECT DISTINCT fold AS h FROM mx),
mom AS (SELECT h, {cols} FROM held JOIN mx ON mx.fold <> h GROUP BY h)"""


def fold_scale_sql() -> str:
    sel = ", ".join(f"{sig(f'm{i}')} AS mean__{c}, {sig(f's{i}')} AS std__{c}" for i, (c, _) in enumerate(matrix_columns()))
    return f"WITH {_mx_cte()},\n{_moments_cte()}\nSELECT h AS fold, {sel} FROM mom"


def impute_rows_sql() -> str:
    sel = ", ".join(f"{r6(f'coalesce(f{i}, d{i}, 0.0)')} AS {c}" for i, (c, _) in enumerate(matrix_columns()))
    return f"""WITH {_mx_cte()},
{_meds_cte('gpu_name')}
SELECT {KEYS}, {sel} FROM mx LEFT JOIN med ON mx.gpu_name = med.h"""


def scale_rows_sql() -> str:
    sel = ", ".join(f"{r6(f'(f{i} - m{i}) / s{i}')} AS {c}" for i, (c, _) in enumerate(matrix_columns()))
    return f"WITH {_mx_cte()},\n{_moments_cte()}\nSELECT {KEYS}, {sel} FROM mx JOIN mom ON mx.fold = mom.h"


RIDGE_STEPS = 60  # conjugate-gradient steps; the system's eigenvalues lie in [1, 1 + columns]


def _ridge_cte(fold: str, base_drop, min_rows: int) -> str:
    """Row predictions p (pf, pb) of ridge fitted on the other folds: imputed,
    standardised, penalty 1, normal equations by conjugate gradients."""
    names = [c for c, _ in matrix_columns()]
    n = len(names)
    base = [i for i, c in enumerate(names) if not base_drop(c)]
    lists = lambda idx, f: "[" + ", ".join(f(i) for i in idx) + "]"
    full = list(range(n))
    g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    parts = [_mx_cte(), _meds_cte(fold)]
    parts.append(f"im AS (SELECT h, yf, yb, {', '.join(f'coalesce(f{i}, d{i}, 0.0) AS x{i}' for i in full)} FROM mx JOIN med ON mx.{fold} IS DISTINCT FROM h)")
    parts.append(f"xst AS (SELECT h, avg(yf) AS yfm, avg(yb) AS ybm, {', '.join(f'avg(x{i}) AS m{i}, stddev_pop(x{i}) AS sd{i}' for i in full)} FROM im GROUP BY h)")
    parts.append("sc AS (SELECT h, yfm, ybm, " + ", ".join(
        f"m{i}, CASE WHEN sd{i} * sd{i} > 1e-20 * (m{i} * m{i} + sd{i} * sd{i}) THEN sd{i} END AS s{i}" for i in full) + " FROM xst)")
    parts.append("z AS (SELECT h, yf - yfm AS uf, yb - ybm AS ub, " + ", ".join(f"coalesce((x{i} - m{i}) / s{i}, 0.0) AS z{i}" for i in full)
                 + " FROM im JOIN sc USING (h))")
    parts.append("gm AS (SELECT h, " + ", ".join(f"avg(z{i} * z{j}) AS g{i}_{j}" for i in full for j in range(i, n)) + ", "
                 + ", ".join(f"avg(z{i} * uf) AS cf{i}, avg(z{i} * ub) AS cb{i}" for i in full) + " FROM z GROUP BY h)")
    parts.append(f"""sys AS (SELECT h, 'f' AS s, {lists(full, lambda i: lists(full, lambda j: g(i, j)))} AS a, {lists(full, lambda i: f'cf{i}')} AS b FROM gm
  UNION ALL SELECT h, 'b' AS s, {lists(base, lambda i: lists(base, lambda j: g(i, j)))} AS a, {lists(base, lambda i: f'cb{i}')} AS b FROM gm)""")
    parts.append("it0 AS (SELECT h, s, a, list_transform(b, lambda v: 0.0) AS x, b AS r, b AS p, list_dot_product(b, b) AS rr FROM sys)")
    for k in range(RIDGE_STEPS):
        parts.append(f"""iq{k} AS (SELECT *, list_transform(list_zip(a, p), lambda v: list_dot_product(v[1], p) + v[2]) AS q FROM it{k}),
ia{k} AS (SELECT *, CASE WHEN list_dot_product(p, q) > 1e-300 THEN rr / list_dot_product(p, q) ELSE 0.0 END AS al FROM iq{k}),
ir{k} AS (SELECT h, s, a, p, rr, list_transform(list_zip(x, p), lambda v: v[1] + al * v[2]) AS x,
                 list_transform(list_zip(r, q), lambda v: v[1] - al * v[2]) AS r FROM ia{k}),
it{k + 1} AS MATERIALIZED (SELECT h, s, a, x, r, list_transform(list_zip(r, p), lambda v: v[1] + CASE WHEN rr > 0 THEN list_dot_product(r, r) / rr ELSE 0.0 END * v[2]) AS p,
                 list_dot_product(r, r) AS rr FROM ir{k})""")
    z_full = lists(full, lambda i: f"coalesce((coalesce(f{i}, d{i}, 0.0) - m{i}) / s{i}, 0.0)")
    z_base = lists(base, lambda i: f"coalesce((coalesce(f{i}, d{i}, 0.0) - m{i}) / s{i}, 0.0)")
    last = f"it{RIDGE_STEPS}"
    parts.append(f"""p AS (SELECT mx.gpu_name, model, vcpu, storage, yf AS y, yfm + list_dot_product({z_full}, bf.x) AS pf, ybm + list_dot_product({z_base}, bb.x) AS pb
  FROM mx JOIN held ON mx.{fold} = held.h AND rows_h >= {min_rows} JOIN med ON med.h = held.h JOIN sc ON sc.h = held.h
  JOIN {last} bf ON bf.h = held.h AND bf.s = 'f' JOIN {last} bb ON bb.h = held.h AND bb.s = 'b')""")
    return ",\n".join(parts)


def oof_ridge_sql() -> str:
    return f"""WITH {_ridge_cte('fold', lambda c: c in ('vcpu', 'storage_SSD'), 1)},
s AS (SELECT coalesce(model, 'nan') AS model, vcpu, coalesce(storage, 'nan') AS storage, {_group_stats('')} FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT model, vcpu, storage, n_samples, {r6('rf')} AS RMSE_full_ms, {r6('rb')} AS RMSE_base_ms,
  {r6('CASE WHEN rb > 0 THEN 100.0 * (rb - rf) / rb END')} AS Improvement_pct FROM s"""


def logo_ridge_sql() -> str:
    return f"""WITH {_ridge_cte('gpu_name', lambda c: c in ('vcpu', 'storage_SSD'), 3)},
s AS (SELECT gpu_name, {_group_stats('')} FROM p GROUP BY gpu_name)
SELECT gpu_name AS GPU, n_samples, {sig('rf')} AS RMSE_full_ms, {sig('rb')} AS RMSE_base_ms,
  CASE WHEN rb > 0 THEN {sig('(100.0 * (rb - rf) / rb)')} END AS Improvement_pct FROM s"""


def oof_predict_sql() -> str:
    return f"""WITH {_eval_cte()},
{_lfo_linear('d', 'fold', 'x')}
SELECT {KEYS}, {r6('CASE WHEN d.x IS NOT NULL THEN cf.a + cf.b * d.x ELSE cf.ybar END')} AS pred_full,
  {r6('CASE WHEN d.x IS NOT NULL THEN cb.a + cb.b * d.x ELSE cb.ybar END')} AS pred_base
FROM d JOIN c_full cf ON cf.fk = d.fold JOIN c_base cb ON cb.fk = d.fold"""


def logo_predict_sql() -> str:
    return f"""WITH {_eval_cte()},
{_lfo_linear('d', 'gpu_name', 'x')},
held AS (SELECT gpu_name FROM d WHERE gpu_name IS NOT NULL GROUP BY gpu_name HAVING count(*) >= 3)
SELECT {KEYS}, d.gpu_name, {r6('CASE WHEN d.x IS NOT NULL THEN cf.a + cf.b * d.x ELSE cf.ybar END')} AS pred_full,
  {r6('CASE WHEN d.x IS NOT NULL THEN cb.a + cb.b * d.x ELSE cb.ybar END')} AS pred_base
FROM d JOIN c_full cf ON cf.fk = d.gpu_name JOIN c_base cb ON cb.fk = d.gpu_name
WHERE d.gpu_name IN (SELECT gpu_name FROM held)"""


def choice_one_hot_sql() -> str:
    cols = [f"CAST(model = '{v}' AS INTEGER) AS model_{v}" for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]
    cols.append("CAST(optimizer = 'SGD' AS INTEGER) AS opt_SGD")
    return f"WITH {_eval_cte()}\nSELECT {KEYS}, {', '.join(cols)} FROM d"


def distinct_keys_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT DISTINCT model, vcpu, storage FROM trials ORDER BY 1, 2, 3"""


# ------------------------------------------------------------------ text ---

def _pat() -> str:
    from .operators.text import WORD_PATTERN
    return "'" + WORD_PATTERN.replace("'", "''") + "'"


def _tok(text: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), {_pat()}), lambda x: lower(x))"


def tokenize_sql() -> str:
    return f"""SELECT doc_id, array_to_string({_tok('text')}, ' ') AS tokens, len({_tok('text')}) AS n_tokens
FROM documents"""


def _doc_toks_cte(src: str = "documents", idc: str = "doc_id", textc: str = "text", side: int = 0,
                  name: str = "toks") -> str:
    return f"""{name} AS (
  SELECT {idc} AS doc_id, {side} AS side, unnest(l) AS token, unnest(range(len(l))) AS pos
  FROM (SELECT {idc}, {_tok(textc)} AS l FROM {src}))"""


def _vocab_cte(toks: str = "toks") -> str:
    return f"""cnt AS (SELECT token, count(*) AS freq,
         min(struct_pack(s := side, d := doc_id, p := pos)) AS first_seen
       FROM {toks} GROUP BY token),
ranked AS (SELECT token, CAST(row_number() OVER (ORDER BY freq DESC, first_seen) + 3 AS INTEGER) AS token_id, freq
           FROM cnt ORDER BY freq DESC, first_seen LIMIT 29996),
voc AS (SELECT * FROM (VALUES ('<unk>', 0), ('<pad>', 1), ('<bos>', 2), ('<eos>', 3)) AS s(token, token_id)
        CROSS JOIN (SELECT CAST(NULL AS BIGINT) AS freq)
        UNION ALL SELECT token, token_id, freq FROM ranked)"""


def vocab_sql() -> str:
    return f"""WITH {_doc_toks_cte()},
{_vocab_cte()}
SELECT token, CAST(token_id AS INTEGER) AS token_id, freq FROM voc"""


def _encode_cte(src: str, idc: str, textc: str, keep: int, name: str) -> str:
    return f"""{_doc_toks_cte(src, idc, textc, 0, name + '_t')},
{name}_g AS (SELECT t.doc_id, list(coalesce(v.token_id, 0) ORDER BY t.pos) AS ids
       FROM {name}_t t LEFT JOIN voc v ON v.token = t.token WHERE t.pos < {keep} GROUP BY t.doc_id),
{name} AS (SELECT s.{idc} AS doc_id, coalesce(g.ids, [0]) AS ids
       FROM {src} s LEFT JOIN {name}_g g ON g.doc_id = s.{idc})"""


def encode_sql() -> str:
    return f"""WITH {_doc_toks_cte()},
{_vocab_cte()},
{_encode_cte('documents', 'doc_id', 'text', 128, 'enc')}
SELECT doc_id, array_to_string(ids[1:128], ' ') AS ids, len(ids[1:128]) AS n_ids FROM enc"""


def pad_sql() -> str:
    return f"""WITH {_doc_toks_cte()},
{_vocab_cte()},
{_encode_cte('documents', 'doc_id', 'text', 128, 'enc')}
SELECT doc_id, array_to_string(list_resize(ids[1:128], 128, 1), ' ') AS padded,
  least(len(ids[1:128]), 128) AS length FROM enc"""


def _pairs_cte() -> str:
    raw = fx.duckdb_view(fx.PAIRS_SQL)
    return f"""praw AS ({raw}),
pairs AS (SELECT pair_id, coalesce(nullif(src_primary, ''), nullif(src_fallback, ''), '') AS src,
                 coalesce(nullif(tgt_primary, ''), nullif(tgt_fallback, ''), '') AS tgt FROM praw)"""


def corpus_pairs_sql() -> str:
    return f"WITH {_pairs_cte()}\nSELECT pair_id, src, tgt FROM pairs"


def _pair_vocab_cte() -> str:
    return f"""{_pairs_cte()},
{_doc_toks_cte('pairs', 'pair_id', 'src', 0, 'ts')},
{_doc_toks_cte('pairs', 'pair_id', 'tgt', 1, 'tt')},
toks AS (SELECT * FROM ts UNION ALL SELECT * FROM tt),
{_vocab_cte()}"""


def vocab_pairs_sql() -> str:
    return f"""WITH {_pair_vocab_cte()}
SELECT token, CAST(token_id AS INTEGER) AS token_id, freq FROM voc"""


def encode_pairs_sql() -> str:
    return f"""WITH {_pair_vocab_cte()},
{_encode_cte('pairs', 'pair_id', 'src', 127, 'es')},
{_encode_cte('pairs', 'pair_id', 'tgt', 127, 'et')}
SELECT es.doc_id AS pair_id, array_to_string(([2] || es.ids || [3])[1:128], ' ') AS src_ids,
  array_to_string(([2] || et.ids || [3])[1:128], ' ') AS tgt_ids
FROM es JOIN et ON es.doc_id = et.doc_id"""


# -------------------------------------------------------------- manifest ---

def _classes_cte() -> str:
    return f"""clist AS (SELECT trim(line) AS class_name, ord FROM ({fx.duckdb_view(fx.CLASS_LIST_SQL)}) WHERE trim(line) <> ''),
cls AS (SELECT class_name, CAST(max(i) AS INTEGER) AS label_idx
        FROM (SELECT class_name, row_number() OVER (ORDER BY ord) - 1 AS i FROM clist) GROUP BY class_name)"""


def _manifest_cte() -> str:
    return f"""pf AS ({fx.duckdb_view(fx.PAGES_SQL)}),
{_classes_cte()},
man AS (SELECT path, label_idx, n_bytes FROM pf JOIN cls USING (class_name)
        WHERE regexp_matches(lower(path), '\\.(html)$'))"""


def manifest_sql() -> str:
    return f"WITH {_manifest_cte()}\nSELECT path, label_idx, n_bytes FROM man"


def manifest_bytes_sql() -> str:
    return f"""WITH {_manifest_cte()},
per AS (SELECT label_idx, avg(n_bytes) AS a FROM man GROUP BY label_idx)
SELECT class_name, cls.label_idx, {r6('coalesce(a, 0.0)')} AS avg_bytes FROM cls LEFT JOIN per USING (label_idx)"""


def manifest_val_sql() -> str:
    return f"""WITH files AS ({fx.duckdb_view(fx.VAL_FILES_SQL)}),
ann AS ({fx.duckdb_view(fx.ANNOTATION_SQL)}),
mapping AS (SELECT split_part(line, chr(9), 1) AS file, arg_max(split_part(line, chr(9), 2), ord * 2 + k) AS class_name
            FROM ann WHERE contains(line, chr(9)) GROUP BY 1),
{_classes_cte()}
SELECT path, label_idx, n_bytes FROM files JOIN mapping USING (file) JOIN cls USING (class_name)
WHERE regexp_matches(lower(path), '\\.(html)$')"""


def manifest_files_sql() -> str:
    return f"""WITH pg AS ({fx.duckdb_view(fx.PAGE_IMAGES_SQL)}),
{_classes_cte()}
SELECT page, label_idx, CAST(bit_length(value) / 8 + 1 AS BIGINT) AS n_bytes FROM pg JOIN cls ON class = class_name"""


def trial_bytes_sql() -> str:
    return f"""WITH {_trials_cte()}, files AS ({fx.duckdb_view(fx.DATASET_FILES_SQL)}),
per AS (SELECT dataset, avg(n_bytes) AS b FROM files GROUP BY dataset)
SELECT {KEYS}, t.dataset, {r6('coalesce(b, 0.0)')} AS disk_bytes_per_sample
FROM trials t LEFT JOIN per ON t.dataset = per.dataset"""


def scan_csv_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, gpu_name, model, vcpu, storage, batch_size,
  CASE WHEN l_suppkey % 2 = 1 THEN {r6('learning_rate')} END AS learning_rate,
  {r6('T_gpu_ms')} AS T_gpu_ms, {r6('avg_batch_time_ms')} AS avg_batch_time_ms,
  CASE WHEN l_suppkey % 2 = 1 THEN model END AS notes
FROM trials WHERE l_suppkey % 2 = 0 OR l_partkey % 50 <> 1"""


def csv_quarantine_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS.replace('l_linenumber', 'CAST(l_linenumber AS BIGINT) AS l_linenumber')}, 'n/a' AS batch_size, 13 AS n_fields FROM trials WHERE l_suppkey % 2 = 1 AND l_partkey % 50 = 1"""


def clean_report_sql() -> str:
    fmt = lambda c: f"coalesce(printf('%.2f', round({c}, 2)), 'nan')"
    num = lambda c: f"TRY_CAST(regexp_replace({c}, '[^0-9.\\-eE]', '', 'g') AS DOUBLE)"
    return f"""WITH {_logo_pred_cte()},
b AS (SELECT model, CAST(batch_size AS VARCHAR) AS bs, avg(y) AS am, avg(pf) AS pfm
      FROM p WHERE model IS NOT NULL AND batch_size IS NOT NULL GROUP BY gpu_name, model, batch_size),
r AS (SELECT model AS m, bs, {fmt('am')} AS a, {fmt('pfm')} || ' ms' AS pr FROM b),
c AS (SELECT m AS Model, {num('bs')} AS Batch, {num('a')} AS Actual, {num('pr')} AS Predicted FROM r)
SELECT Model, Batch, Actual, Predicted,
  {r6('CASE WHEN Actual <> 0 THEN 100.0 * abs(Predicted - Actual) / Actual END')} AS Error
FROM c WHERE Model IS NOT NULL AND Batch IS NOT NULL AND Actual IS NOT NULL AND Predicted IS NOT NULL"""


def dedup_columns_sql() -> str:
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, {r6('T_gpu_ms')} AS T_gpu_ms, vcpu, gpu_name FROM trials"""


def transformer_features_sql() -> str:
    B = "CAST(batch_size AS DOUBLE)"
    act = "CAST(act_bytes_per_seq_proxy AS DOUBLE)"
    tc = (f"flops_train_per_batch / greatest(1e-9, CASE WHEN amp_i = 1 AND FP16 IS NOT NULL "
          f"THEN FP16 ELSE coalesce(FP32, 0.0) END) * 1000.0")
    tm = f"{act} * {B} / greatest(1.0, coalesce(bw_gbs * 1073741824.0, 0.0)) * 1000.0"
    return f"""WITH g AS ({flops_transformer_sql()}),
spec AS ({GPU_SPEC}),
e AS (SELECT g.*, s.FP16, s.FP32, s.mem_gb, s.bw_gbs, CAST(prec_bits = 16 AS INTEGER) AS amp_i,
        coalesce(seq_len, tgt_len, src_len) AS eff
      FROM g LEFT JOIN spec s ON g.gpu_name = s.gpu_name),
r AS (SELECT e.*, {tc} AS tc, {tm} AS tm FROM e),
r1 AS (SELECT r.*, CASE WHEN tc IS NOT NULL AND tm IS NOT NULL THEN greatest(tc, tm) END AS roof_raw FROM r),
st AS (SELECT median(roof_raw) AS med_roof, count(roof_raw) AS n_roof, median(eff) AS med_eff FROM r1)
SELECT gpu_name, storage, vcpu, model, dataset, optimizer, learning_rate, batch_size, prec_bits,
  flops_train_per_seq AS F_TR_seq, flops_train_per_batch AS F_TR_batch,
  {r6('ln(1 + flops_train_per_seq)')} AS log_F_TR_seq, {r6('ln(1 + flops_train_per_batch)')} AS log_F_TR_batch,
  eff AS eff_seq_len, {r6('ln(1 + coalesce(eff, (SELECT med_eff FROM st), 1.0))')} AS log_eff_seq_len,
  flops_train_per_batch / greatest(1.0, {B}) AS F_TR_sample,
  {r6(f'ln(1 + flops_train_per_batch / greatest(1.0, {B}))')} AS log_F_TR_sample,
  amp_i AS amp, {_arch_case('gpu_name')} AS arch_family_inferred,
  {r6(f'(0.0 + {act} * {B}) / greatest(1.0, coalesce(mem_gb, 0.0) * 1073741824.0)')} AS mem_pressure,
  {r6('CASE WHEN (SELECT n_roof FROM st) = 0 THEN 0.0 ELSE coalesce(roof_raw, (SELECT med_roof FROM st)) END')}
    AS roof_time_ms
FROM r1"""


def mlp_features_sql() -> str:
    B = "CAST(batch_size AS DOUBLE)"
    tensor = ("a100", "a40", "a10", "l40", "l4", "h100", "rtx 50", "rtx 5090", "v100", "t4")
    lname = "lower(coalesce(g.gpu_name, 'nan'))"
    return f"""WITH g AS ({flops_mlp_sql()}),
spec AS ({GPU_SPEC})
SELECT g.gpu_name, storage, vcpu, model, dataset, embed_dim, learning_rate, batch_size, optimizer,
  prec_bits, flops_fwd_per_sample * 3.0 AS F_MLP_sample, flops_train_per_batch AS F_MLP_batch,
  {r6('ln(1 + flops_fwd_per_sample * 3.0)')} AS log_F_MLP_sample,
  {r6('ln(1 + flops_train_per_batch)')} AS log_F_MLP_batch,
  {r6(f'log2(greatest(1.0, {B}))')} AS log2_batch_size,
  {r6(f'{B} / greatest(1.0, nullif(s.SM, 0.0))')} AS B_per_SM,
  {r6(f'{B} / greatest(1.0, nullif(s.mem_gb, 0.0))')} AS B_over_GB,
  {_arch_case('g.gpu_name')} AS arch_family,
  CAST({_contains_any(lname, tensor)} AS INTEGER) AS has_tensor_cores,
  CAST(prec_bits = 16 AS INTEGER) * CAST({_contains_any(lname, tensor)} AS INTEGER) AS tc_util_proxy
FROM g LEFT JOIN spec s ON g.gpu_name = s.gpu_name"""


def write_trials_sql() -> str:
    s = "regexp_replace(gpu_name, '[<>:\"/\\\\|?*\\x00-\\x1F]', '_', 'g')"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', '_', 'g')"
    return f"""WITH {_trials_cte()}
SELECT {KEYS}, architecture, gpu_name, substring({s}, 1, 140) AS gpu_slug, {r6('T_gpu_ms')} AS T_gpu_ms
FROM trials"""


# The full model's feature columns on the fixture (numeric columns minus
# target, leaky, categorical, id/text and key columns) and the log1p twins
# selected by the profile (see LOG1P_COLUMNS, cross-checked by skew_profile).
MATRIX_FEATURES = (
    "vcpu", "batch_size", "prec_bits", "learning_rate", "param_count", "flops_fwd_per_sample",
    "act_bytes_per_sample_proxy", "amp", "param_bytes", "optimizer_state_bytes",
    "master_param_bytes", "total_state_bytes", "flops_train_per_sample", "flops_train_per_batch",
    "arithmetic_intensity_train", "FP16", "FP32", "FP64", "mem_gb", "bw_gbs", "SM",
    "total_vram_bytes", "bw_per_gb", "mem_type_GDDR7", "mem_type_HBM2", "mem_type_HBM2e",
    "mem_type_nan", "bus_SXM2", "bus_nan", "gpu_arch_Ampere", "gpu_arch_Blackwell",
    "gpu_arch_Hopper", "gpu_arch_Turing", "gpu_arch_Volta", "gpu_arch_nan", "arch_Ampere",
    "arch_Hopper", "arch_Turing", "arch_Unknown", "has_tensor_cores", "is_pcie", "is_sxm",
    "is_datacenter", "has_HBM", "flops_to_bw_ratio", "flops_to_FP32_ratio", "flops_to_FP16_ratio",
    "flops_to_FP64_ratio", "ai_over_fp32", "storage_SSD", "FP16_per_trainflop",
    "FP32_per_trainflop", "F_CNN_sample", "F_CNN_batch", "log_F_CNN_sample", "log_F_CNN_batch",
    "log2_batch_size", "batch_bin_small", "batch_bin_medium", "batch_bin_large", "B_per_SM",
    "B_over_GB", "B_times_BW", "B_times_SM", "mem_pressure", "roof_time_ms", "mem_headroom",
    "near_vram_limit", "tc_util_proxy", "B_times_tc", "B_times_headroom", "B_times_arch_Ampere",
    "B_times_arch_Ada", "B_times_arch_Hopper")


def _matrix_sql(target: str, drop=()) -> str:
    sel = []
    for c in MATRIX_FEATURES:
        if c in drop:
            continue
        src = "amp_int" if c == "amp" else c
        sel.append(f"{r6(f'CAST({src} AS DOUBLE)')} AS {c}")
    for c in LOG1P_COLUMNS:
        sel.append(f"{r6(f'ln(1 + CAST({c} AS DOUBLE))')} AS log1p__{c}")
    return f"WITH {_features_cte()}\nSELECT {KEYS}, {', '.join(sel)}, {r6(target)} AS {target} FROM feat"


def feature_matrix_train_sql() -> str:
    x = lambda c: f"CAST({'amp_int' if c == 'amp' else c} AS DOUBLE)"
    take = ", ".join(
        f"""(coalesce(NOT bool_or({x(c)} < 0), true) AND NOT (count(CASE WHEN {x(c)} NOT IN (0.0, 1.0) THEN 1 END) = 0 AND count(*) = count({x(c)}))
      AND count({x(c)}) >= 3 AND coalesce(skewness({x(c)}) > 1.0 AND NOT isnan(skewness({x(c)})), false)) AS take_{c}""" for c in LOG1P_COLUMNS)
    sel = [f"{r6(x(c))} AS {c}" for c in MATRIX_FEATURES]
    sel += [f"CASE WHEN take_{c} THEN {r6('ln(1 + ' + x(c) + ')')} END AS log1p__{c}" for c in LOG1P_COLUMNS]
    return f"""WITH {_features_cte(train=True)},
logs AS (SELECT h AS lh, {take} FROM feat_rest GROUP BY h)
SELECT {KEYS}, {', '.join(sel)}, {r6('avg_batch_time_ms')} AS avg_batch_time_ms FROM feat JOIN logs ON feat.fold = logs.lh"""


def feature_matrix_sql() -> str:
    return _matrix_sql("avg_batch_time_ms")


def feature_matrix_base_sql() -> str:
    # the GPU-only baseline drops host features: names with 'vcpu' or 'storage_*'
    return _matrix_sql("T_gpu_ms", drop=("vcpu", "storage_SSD"))


def feature_matrix_base_mlp_sql() -> str:
    return _matrix_sql("T_gpu_ms")


ORACLES = {
    "kfold_report": kfold_report_sql,
    "scan_trials": scan_trials_sql,
    "drop_missing": drop_missing_sql,
    "canon_missing": canon_missing_sql,
    "gpu_slug": gpu_slug_sql,
    "trial_enrich": trial_enrich_sql,
    "union_trials": union_trials_sql,
    "gpu_arch": gpu_arch_sql,
    "gpu_flags": gpu_flags_sql,
    "median_fill": median_fill_sql,
    "skew_profile": skew_profile_sql,
    "log1p_features": log1p_features_sql,
    "feature_matrix": feature_matrix_sql,
    "feature_matrix_base": feature_matrix_base_sql,
    "feature_matrix_train": feature_matrix_train_sql,
    "trial_timing": trial_timing_sql,
    "trial_throughput": trial_throughput_sql,
    "layer_flops": layer_flops_sql,
    "grid_trials": grid_trials_sql,
    "flops_mlp": flops_mlp_sql,
    "flops_transformer": flops_transformer_sql,
    "mem_estimate": mem_estimate_sql,
    "trial_timing_cols": trial_timing_cols_sql,
    "kfold_assign": kfold_assign_sql,
    "kfold_even": kfold_even_sql,
    "kfold_report_even": kfold_report_even_sql,
    "oof_mean": oof_mean_sql,
    "oof_linear": oof_linear_sql,
    "logo_mean": logo_mean_sql,
    "logo_linear": logo_linear_sql,
    "logo_breakdown": logo_breakdown_sql,
    "logo_summary": logo_summary_sql,
    "logo_report": logo_report_sql,
    "kfold_report_overall": kfold_report_overall_sql,
    "kfold_report_mean": kfold_report_mean_sql,
    "fold_impute": fold_impute_sql,
    "oof_ridge": oof_ridge_sql,
    "logo_ridge": logo_ridge_sql,
    "fold_scale": fold_scale_sql,
    "distinct_keys": distinct_keys_sql,
    "report_ymax": report_ymax_sql,
    "format_report": format_report_sql,
    "tokenize": tokenize_sql,
    "vocab": vocab_sql,
    "encode": encode_sql,
    "pad": pad_sql,
    "corpus_pairs": corpus_pairs_sql,
    "vocab_pairs": vocab_pairs_sql,
    "encode_pairs": encode_pairs_sql,
    "manifest": manifest_sql,
    "manifest_bytes": manifest_bytes_sql,
    "manifest_val": manifest_val_sql,
    "manifest_files": manifest_files_sql,
    "feature_matrix_base_logo": feature_matrix_base_sql,
    "feature_matrix_base_mlp": feature_matrix_base_mlp_sql,
    "choice_one_hot": choice_one_hot_sql,
    "trial_timing_tr": lambda: trial_timing_sql("1e-9"),
    "mem_estimate_tr": mem_estimate_tr_sql,
    "oof_predict": oof_predict_sql,
    "logo_predict": logo_predict_sql,
    "impute_rows": impute_rows_sql,
    "scale_rows": scale_rows_sql,
    "trial_bytes": trial_bytes_sql,
    "scan_trials_csv": scan_csv_sql,
    "csv_quarantine": csv_quarantine_sql,
    "clean_report": clean_report_sql,
    "dedup_columns": dedup_columns_sql,
    "transformer_features": transformer_features_sql,
    "mlp_features": mlp_features_sql,
    "write_trials": write_trials_sql,
    "stream_trial_timing": trial_timing_sql,
    "stream_final_timing": trial_timing_sql,
    "stream_window_rollup": stream_window_sql,
    **{g: _feature_group_sql(g) for g in ("hw_ratios", "mem_pressure", "batch_features", "batch_hw",
                                           "roofline", "tc_util", "flops_features", "one_hot")},
}


def digits(key: str) -> int:
    return 4 if key in AGG_KEYS else 6


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, f in ORACLES.items():
        _DIGITS["d"] = digits(k)
        out[k] = f()
    _DIGITS["d"] = 6
    return out
