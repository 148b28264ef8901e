"""Features whose statistics come from training rows only (``stats_scope='train'``).

Every row is predicted by the model of its own fold, so its fills, one-hot
columns and log1p choices follow from the other folds' rows.  All folds share
one pass per statistic:

* category sets, counts and hardware medians come from the per-(fold, GPU)
  table, medians of per-trial columns from per-fold value counts;
* the heavy-tail profile needs third moments.  They are aggregated per fold and
  merged for every held-out fold.  A column that is filled with a median is
  aggregated apart where it is present and where it is missing: the filled part
  is median times a known factor, so its moments follow once the median is
  known, and no row is read again for any fold.

The rows then join their fold's statistics (one small row per fold).  A column
that the model of a fold does not have (its category or its heavy tail is only
in that fold) is NULL for the fold's rows.  Rows of a NULL fold only train;
they are not in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FamilyConfig
from ..functions.nulls import as_category, dbl
from ..storage import written
from .columns import arrays, column_moments, names_of
from .features import Stats, _raw_roof, _sm_col, engineer, stats_frame
from .leaveout import leave_out_extremes, leave_out_moments, leave_out_sums, merge_moments
from .profile import skew_candidates

OF_VRAM = ("mem_pressure", "mem_headroom", "near_vram_limit", "B_times_headroom")
PRODUCTS, CUBES = {"q": ("m", "m")}, {"t": ("m", "q")}


def _factors(e: DataFrame, fam: FamilyConfig) -> dict:
    """Filled columns: name -> (unfilled value, factor of the median where it is missing, median, fill without a median)."""
    B, sm = dbl("batch_size"), _sm_col(e, fam)
    bw = dbl("bw_gbs") if "bw_gbs" in e.columns else F.lit(None).cast("double")
    sm = sm if sm is not None else F.lit(None).cast("double")
    return {"B_times_BW": (B * bw, F.when(bw.isNull(), B), "med_bw", 0.0), "B_times_SM": (B * sm, F.when(sm.isNull(), B), "med_sm", 0.0),
            "roof_time_ms": (_raw_roof(e, fam), F.when(_raw_roof(e, fam).isNull(), F.lit(1.0)), "med_roof", None)}


def fold_profile(e: DataFrame, plain: dict, filled: dict, stats: DataFrame, fold_col: str) -> DataFrame:
    """(held, column, n, n_missing, skew, take_log) of the training rows of every held-out fold.

    ``plain``: column -> value; ``filled``: as ``_factors``; ``stats``: medians per held fold."""
    cells = [(c, "own", x) for c, x in plain.items()]
    for c, (x, factor, _, _) in filled.items():
        cells += [(c, "own", x), (c, "filled", factor)]
    m = column_moments(arrays(e, F.col(fold_col), [x for _, _, x in cells]), len(cells))
    m = m.select(names_of([c for c, _, _ in cells]).alias("column"), names_of([part for _, part, _ in cells]).alias("part"), "fold",
                 "n", "rows", "m", "q", "t", "non01", "negative", "lo", "lo_pos", "hi")
    m = written(m, "moments")
    by = ["column", "part"]
    rest = leave_out_moments(m, "fold", "n", ["m"], PRODUCTS, by, CUBES)
    counts = leave_out_extremes(leave_out_sums(m, "fold", ["rows", "non01", "negative"], by), "fold", ["lo", "lo_pos"], ["hi"], by)
    rest = written(rest.where(F.col("fold").isNotNull()).join(
        counts.select(*by, "fold", *[f"t_{c}" for c in ("rows", "non01", "negative", "lo", "lo_pos", "hi")]), [*by, "fold"]), "rest")
    moments = lambda p="": F.struct(*[F.col(f"t_{c}").alias(c) for c in ("n", "m", "q", "t")])
    own = rest.where("part = 'own'").select("column", F.col("fold").alias("held"), moments().alias("a"), F.col("t_rows").alias("rows"),
                                            F.col("t_non01").alias("non01"), F.col("t_negative").alias("negative"))
    # The filled part: the factor's moments times the median.
    med = F.lit(None).cast("double")
    for c, (_, _, name, default) in filled.items():
        med = F.when(F.col("column") == c, F.coalesce(F.col(name), F.lit(default).cast("double"))).otherwise(med)
    f = rest.where("part = 'filled'").join(stats.select(F.col("held").alias("fold"), *{v[2] for v in filled.values()}), "fold").withColumn("med", med)
    has = F.col("med").isNotNull() & (F.col("t_n") > 0)
    scaled = F.struct(F.when(has, F.col("t_n")).otherwise(0.0).alias("n"), *[
        F.coalesce(F.when(has, F.col(f"t_{c}") * F.pow(F.col("med"), F.lit(float(k)))), F.lit(0.0)).alias(c) for k, c in ((1, "m"), (2, "q"), (3, "t"))])
    ends = [F.col("med") * F.col(f"t_{c}") for c in ("lo", "hi")]
    binary = (F.col("med") == 0) | ((F.col("t_lo") >= 0) & F.coalesce(
        (F.col("med") * F.col("t_lo_pos") == 1.0) & (F.col("med") * F.col("t_hi") == 1.0), F.lit(True)))
    f = f.select("column", F.col("fold").alias("held"), scaled.alias("b"), (has & ~binary).alias("b_non01"),
                 (has & (F.least(*ends) < 0)).alias("b_negative"))
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "m", "q", "t")])
    both = own.join(f, ["column", "held"], "left").withColumn("b", F.coalesce("b", none))
    both = both.withColumn("all", merge_moments(F.col("a"), F.col("b"), "n", ["m"], PRODUCTS, CUBES))
    n, q, t = F.col("all.n"), F.col("all.q"), F.col("all.t")
    g1 = F.when((n >= 3) & (q > 0), F.sqrt(n) * t / (q * F.sqrt(q)) * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    negative = (F.col("negative") > 0) | F.coalesce("b_negative", F.lit(False))
    missing = F.col("rows") - n
    is_binary = (F.col("non01") == 0) & ~F.coalesce("b_non01", F.lit(False)) & (missing == 0)
    return both.select("held", "column", n.cast("bigint").alias("n"), missing.cast("bigint").alias("n_missing"), g1.alias("skew"),
                       (~negative & ~is_binary & F.coalesce(g1 > 1.0, F.lit(False))).alias("take_log"))


def train_features(e: DataFrame, fam: FamilyConfig, target: str, fold_col: str = "fold", extra_drop=()) -> DataFrame:
    """The feature frame of enriched trials with train-only statistics (image families)."""
    if fam.flops_prefix == "F_TR":
        raise ValueError("train-only statistics are built for the image families")
    cats = [c for c in fam.categorical if c in e.columns]
    stats = written(stats_frame(e, fam, fold_col), "fold-stats")
    seen = stats.agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
                       for c in (*[f"cats__{c}" for c in cats], "arch")]).collect()[0].asDict()  # category names
    own = {c: F.col(f"__{c}") for c in stats.columns if c != "held"}
    st = Stats(categories={c: list(seen[f"cats__{c}"]) for c in cats if seen[f"cats__{c}"]}, arch_families=list(seen["arch"]),
               median_bw=own["med_bw"], median_sm=own["med_sm"], median_roof=own["med_roof"], vram_all_missing=own["n_vram"] == 0)
    one_row = stats.select(F.col("held").alias("__held"), *[F.col(c).alias(f"__{c}") for c in stats.columns if c != "held"])
    joined = e.join(one_row, F.col(fold_col) == F.col("__held"))
    f = engineer(joined, fam, st)
    # A category is a column of the fold's model if its training rows have it and it is not their first.
    hot = {}
    arch = "arch_family_inferred" if fam.keep_arch_family else "arch_family"
    for c, names, values, prefix in [*[(c, own[f"cats__{c}"], st.categories[c], c) for c in st.categories], (arch, own["arch"], st.arch_families, "arch")]:
        any_value = own[f"n__{c}"] > 0 if c in st.categories else F.lit(True)
        value = as_category(c) if c in st.categories else F.col(arch)
        for v in sorted(values)[1:]:
            hot[f"{prefix}_{v}"] = F.when(any_value & (F.array_position(names, v) > 1), (value == F.lit(v)).cast("int"))
    f = f.withColumns(hot)
    # Heavy tails: the columns without their fold-dependent part.  Where the training rows of a fold have no VRAM
    # figure at all, some columns use the memory size instead; both forms are profiled and the fold picks one.
    filled = _factors(e, fam)
    base = dict(categories=st.categories, arch_families=st.arch_families, median_bw=None, median_sm=None, median_roof=None)
    other = engineer(e, fam, Stats(**base, vram_all_missing=True)).select(*e.columns, *[F.col(c).alias(f"__alt_{c}") for c in OF_VRAM])
    frame = engineer(other, fam, Stats(**base, vram_all_missing=False))
    columns = [c for c in skew_candidates(frame, target, fam.leaky, [*extra_drop, fold_col]) if c not in hot and c not in filled]
    profile = fold_profile(frame, {c: F.col(c) for c in columns}, filled, stats, fold_col)
    profile = profile.join(stats.select("held", "n_vram"), "held").withColumn("alt", F.startswith("column", F.lit("__alt_")))
    profile = profile.withColumn("column", F.regexp_replace("column", "^__alt_", "")).where(
        ~F.col("column").isin(*OF_VRAM) | (F.col("alt") == (F.col("n_vram") == 0)))
    take = written(profile.where("take_log").groupBy("held").agg(F.collect_set("column").alias("__logs")), "logs")
    taken = sorted({c for r in take.collect() for c in r["__logs"]})  # column names
    f = f.join(take.withColumnRenamed("held", "__log_held"), F.col(fold_col) == F.col("__log_held"), "left")
    f = f.withColumns({f"log1p__{c}": F.when(F.array_contains("__logs", c), F.log1p(dbl(c))) for c in taken})
    return f.drop(*[c for c in f.columns if c.startswith("__")])
