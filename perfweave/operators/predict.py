"""Out-of-sample prediction as a column.

Exact leave-fold-out predictors are trained for ALL folds in one pass:
per-fold sufficient statistics (one ``groupBy(fold)`` aggregate, k rows),
leave-out statistics as the merge of the folds before and the folds after a
fold (``leaveout``; on the k-row summary, never over facts), then one join of
the small coefficient table back onto the facts (AQE broadcasts it from its
measured size).  The same code does K-fold (fold = hash fold) and
leave-one-GPU-out (fold = gpu_name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import dbl
from ..storage import written
from .columns import TOP_BITS, MANY, arrays, column_moments, names_of, range_counts
from .leaveout import leave_out_moments, leave_out_sums


def holdout_flags(df: DataFrame, fold_col: str, min_rows: int = 1) -> DataFrame:
    """Fold table: fold value, row count and whether it is held out.

    A NULL fold (e.g. unknown GPU) always trains and is never tested; a fold
    with fewer than ``min_rows`` rows trains but is not held out (M4, P10).
    """
    return (df.groupBy(fold_col).agg(F.count(F.lit(1)).alias("fold_rows"))
              .withColumn("held_out", F.col(fold_col).isNotNull() & (F.col("fold_rows") >= min_rows)))


def fold_group_sums(df: DataFrame, fold_col: str, group_cols, targets) -> DataFrame:
    """ONE pass over the facts: per (fold, group) row count and, for every
    target, its sum and non-missing count.  k x groups rows - every
    group-mean model (any coarser grouping) derives from this table."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for y in targets:
        aggs += [F.sum(dbl(y)).alias(f"s__{y}"), F.count(y).alias(f"n__{y}")]
    return written(df.groupBy(fold_col, *group_cols).agg(*aggs), "sums")


def leave_out_group_mean_from(sums: DataFrame, fold_col: str, y: str, group_cols=(),
                              name: str = "pred") -> DataFrame:
    """Per (fold, group): mean of ``y`` over the OTHER folds' rows of the same
    group, falling back to the other folds' overall mean (M6a), computed on
    the (small) fold-group sums table."""
    g = sums.groupBy(fold_col, *group_cols).agg(F.sum(f"s__{y}").alias("s"), F.sum(f"n__{y}").alias("n"))
    g = leave_out_sums(g, fold_col, ["s", "n"], group_cols)
    f = sums.groupBy(fold_col).agg(F.sum(f"s__{y}").alias("s0"), F.sum(f"n__{y}").alias("n0"))
    f = leave_out_sums(f, fold_col, ["s0", "n0"]).select(F.col(fold_col).alias("__fold"), "t_s0", "t_n0")
    out = g.join(f, F.col(fold_col).eqNullSafe(F.col("__fold")), "left")
    pred = F.when(F.col("t_n") > 0, F.col("t_s") / F.col("t_n")).otherwise(
        F.try_divide(F.col("t_s0"), F.col("t_n0")))
    return out.select(fold_col, *group_cols, pred.alias(name),
                      F.col("t_n").alias(f"{name}_train_rows"))


def leave_out_group_mean(df: DataFrame, fold_col: str, y: str, group_cols=(),
                         name: str = "pred") -> DataFrame:
    """Leave-fold-out group means straight from the facts."""
    sums = fold_group_sums(df, fold_col, group_cols, [y])
    return leave_out_group_mean_from(sums, fold_col, y, group_cols, name)


def _moments(x, y, tag: str) -> list:
    """Aggregates of the pairs with x and y: count, means and centred sums of
    squares and products (never raw sums of squares, which cancel)."""
    return [F.regr_count(y, x).cast("double").alias(f"n__{tag}"), F.regr_avgx(y, x).alias(f"mx__{tag}"),
            F.regr_avgy(y, x).alias(f"my__{tag}"), F.regr_sxx(y, x).alias(f"cxx__{tag}"),
            F.regr_sxy(y, x).alias(f"cxy__{tag}"), F.regr_syy(y, x).alias(f"cyy__{tag}")]


def linear_fold_sums(df: DataFrame, fold_col: str, x: str, targets, keys=(), more=()) -> DataFrame:
    """ONE pass over the facts: per (fold, *keys) cell the row count and, for
    each target, the moments of the rows with x and y and the count and mean
    of all rows with y.  The cells are written once; everything else is
    derived from them."""
    aggs = [F.count(F.lit(1)).alias("rows"), *more]
    for y in targets:
        aggs += [*_moments(dbl(x), dbl(y), y), F.count(dbl(y)).cast("double").alias(f"ny__{y}"),
                 F.avg(dbl(y)).alias(f"mya__{y}")]
    cells = [fold_col] + [k for k in keys if k != fold_col]
    return written(df.groupBy(*cells).agg(*aggs), "cells")


def _fold_pair_moments(cells: DataFrame, fold_col: str, y: str) -> DataFrame:
    """Cells merged to one row per fold: counts, means, centred sums.  The
    fold's own means come first, so a cell adds its deviation from them only."""
    c = {p: F.coalesce(F.col(f"{p}__{y}"), F.lit(0.0)) for p in ("n", "mx", "my", "cxx", "cxy", "ny", "mya")}
    mean = lambda n, m: F.coalesce(F.try_divide(F.sum(c[n] * c[m]), F.sum(c[n])), F.lit(0.0))
    mid = cells.groupBy(fold_col).agg(F.sum(c["n"]).alias("n"), mean("n", "mx").alias("x"), mean("n", "my").alias("y"),
                                      F.sum(c["ny"]).alias("ny"), mean("ny", "mya").alias("ya"))
    mid = mid.withColumnRenamed(fold_col, "__fold")
    dx, dy = c["mx"] - F.col("x"), c["my"] - F.col("y")
    return cells.join(mid, F.col(fold_col).eqNullSafe(F.col("__fold"))).groupBy(F.col("__fold").alias(fold_col)).agg(
        *[F.first(v).alias(v) for v in ("n", "x", "y", "ny", "ya")],
        F.sum(c["cxx"] + c["n"] * dx * dx).alias("xx"), F.sum(c["cxy"] + c["n"] * dx * dy).alias("xy"))


def leave_out_linear_from(cells: DataFrame, fold_col: str, y: str, name: str = "pred") -> DataFrame:
    """Per fold: ``y ~ a + b x`` fitted on the other folds, from the cell
    moments (M6b).  Leave-out mean of y is the fallback prediction for a
    missing x and the intercept when x is constant.
    """
    folds = written(_fold_pair_moments(cells, fold_col, y), "folds")
    s = leave_out_moments(folds, fold_col, "n", ["x", "y"], {"xx": ("x", "x"), "xy": ("x", "y")})
    means = leave_out_moments(folds, fold_col, "ny", ["ya"], {}).select(F.col(fold_col).alias("__fold"), "t_ny", "t_ya")
    s = s.join(means, F.col(fold_col).eqNullSafe(F.col("__fold")))
    n, mx, cxx = F.col("t_n"), F.col("t_x"), F.col("t_xx")
    # x is constant when its spread is no more than rounding of its size.
    spread = cxx > F.lit(1e-18) * (n * mx * mx + cxx)
    s = s.withColumns({f"{name}_b": F.coalesce(F.when(spread, F.col("t_xy") / cxx), F.lit(0.0)),
                       f"{name}_ybar": F.when(F.col("t_ny") > 0, F.col("t_ya"))})
    a = F.when(n > 0, F.col("t_y") - F.col(f"{name}_b") * mx).otherwise(F.col(f"{name}_ybar"))
    return s.select(fold_col, a.alias(f"{name}_a"), f"{name}_b", f"{name}_ybar",
                    n.cast("bigint").alias(f"{name}_train_rows"))


def leave_out_linear(df: DataFrame, fold_col: str, x: str, y: str, name: str = "pred") -> DataFrame:
    """Leave-fold-out simple regression straight from the facts."""
    return leave_out_linear_from(linear_fold_sums(df, fold_col, x, [y]), fold_col, y, name)


def _score_linear(df: DataFrame, model: DataFrame, fold_col: str, x: str, names) -> DataFrame:
    keep = [fold_col] + [f"{n}_{p}" for n in names for p in ("a", "b", "ybar")]
    j = df.join(written(model.select(*keep), "model"), fold_col, "left")
    preds = {n: F.when(dbl(x).isNotNull(), F.col(f"{n}_a") + F.col(f"{n}_b") * dbl(x))
                 .otherwise(F.col(f"{n}_ybar")) for n in names}
    return j.withColumns(preds).drop(*keep[1:])


def oof_group_mean(df: DataFrame, fold_col: str, specs, min_rows: int | None = None) -> DataFrame:
    """Attach out-of-fold group-mean predictions; ``specs`` = [(name, y, groups)].

    One aggregate over the facts at the union of all group keys feeds every
    spec; the per-spec leave-out tables are broadcast back (one join each).
    ``min_rows``: keep only rows of held-out folds (LOGO).
    """
    fine_keys = list(dict.fromkeys(c for _, _, gs in specs for c in gs))
    sums = fold_group_sums(df, fold_col, fine_keys, sorted({y for _, y, _ in specs}))
    if min_rows is not None:
        df = df.join(_held_from(sums, fold_col, min_rows), fold_col, "left_semi")
    for name, y, groups in specs:
        t = written(leave_out_group_mean_from(sums, fold_col, y, groups, name).drop(f"{name}_train_rows"), "model")
        df = df.join(t, [fold_col, *groups], "left")
    return df


def oof_linear(df: DataFrame, fold_col: str, specs, min_rows: int | None = None) -> DataFrame:
    """Attach out-of-fold simple-regression predictions; specs = [(name, x, y)].

    All specs sharing an x are fitted from ONE aggregate over the facts.
    """
    xs = list(dict.fromkeys(x for _, x, _ in specs))
    for x in xs:
        mine = [(n, y) for n, xx, y in specs if xx == x]
        sums = linear_fold_sums(df, fold_col, x, sorted({y for _, y in mine}))
        if min_rows is not None:
            df = df.join(_held_from(sums, fold_col, min_rows), fold_col, "left_semi")
            min_rows = None
        model = None
        for n, y in mine:
            m = leave_out_linear_from(sums, fold_col, y, n).drop(f"{n}_train_rows")
            model = m if model is None else model.join(m, fold_col)
        df = _score_linear(df, model, fold_col, x, [n for n, _ in mine])
    return df


def linear_report_sums(df: DataFrame, fold_col: str, x: str, specs, y_score: str, keys) -> DataFrame:
    """Out-of-fold linear models AND their report sums from ONE pass.

    One aggregate at (fold, *keys) collects the training moments of every
    target and the scoring moments of ``y_score``, split by whether x is
    present.  The k-row leave-out models come from those cells; each cell's
    prediction sum and squared error follow from its centred moments,
    ``cyy - 2b cxy + b^2 cxx + n (my - a - b mx)^2``, with the leave-out
    mean as prediction where x is missing.  The facts are never scored row
    by row.  ``specs`` = [(name, target)]; returns the report-ready table
    ``keys + (n, sy, sp_<name>, se_<name>)``.
    """
    xx, ys = dbl(x), dbl(y_score)
    hx = xx.isNotNull()
    no_x = F.when(~hx, ys)
    more = [F.count_if(hx).cast("double").alias("cx"), F.count_if(~hx).cast("double").alias("c0"),
            F.avg(xx).alias("mx_all"), F.sum(ys).alias("sy_score"), *_moments(xx, ys, "score"),
            F.count(no_x).cast("double").alias("m0"), F.avg(no_x).alias("my0"),
            (F.var_pop(no_x) * F.count(no_x)).alias("cyy0")]
    cells = linear_fold_sums(df, fold_col, x, sorted({t for _, t in specs}), keys, more)
    model = None
    for name, t in specs:
        m = leave_out_linear_from(cells, fold_col, t, name).drop(f"{name}_train_rows")
        model = m if model is None else model.join(m, fold_col)
    j = cells.join(written(model, "model"), fold_col, "left")
    n, mx, my, cxx, cxy, cyy = (F.col(f"{p}__score") for p in ("n", "mx", "my", "cxx", "cxy", "cyy"))
    out = {}
    for name, _ in specs:
        a, b, ybar = F.col(f"{name}_a"), F.col(f"{name}_b"), F.col(f"{name}_ybar")
        out[f"sp_{name}"] = (F.when(F.col("cx") > 0, F.col("cx") * (a + b * F.col("mx_all"))).otherwise(0.0)
                             + F.when(F.col("c0") > 0, ybar * F.col("c0")).otherwise(0.0))
        off, off0 = my - a - b * mx, F.col("my0") - ybar
        out[f"se_{name}"] = (
            F.when(n > 0, F.greatest(F.lit(0.0), cyy - 2.0 * b * cxy + b * b * cxx) + n * off * off).otherwise(0.0)
            + F.when(F.col("m0") > 0, F.col("cyy0") + F.col("m0") * off0 * off0).otherwise(0.0))
    return j.select(*dict.fromkeys([fold_col, *keys]), F.col("rows").alias("n"), F.col("sy_score").alias("sy"),
                    *[c.alias(k) for k, c in out.items()])


def group_mean_report_sums(df: DataFrame, fold_col: str, specs, y_score: str, keys) -> DataFrame:
    """Out-of-fold group-mean models AND their report sums from ONE pass.

    One aggregate at (fold, union of all group keys and report keys) holds
    the training sums of every target and the count, mean and centred sum of
    squares of ``y_score``; each spec's leave-out means come from that table
    and a cell's squared error is ``cyy + n (my - p)^2``.  ``specs`` =
    [(name, target, groups)].  Returns ``fine keys + (n, sy, sp_<name>,
    se_<name>)``.
    """
    ys = dbl(y_score)
    fine_keys = list(dict.fromkeys([fold_col, *[g for _, _, gs in specs for g in gs], *keys]))
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(ys).alias("sy_score"), F.avg(ys).alias("my_score"),
            F.count(ys).cast("double").alias("n_score"), (F.var_pop(ys) * F.count(ys)).alias("cyy_score")]
    for t in sorted({t for _, t, _ in specs}):
        aggs += [F.sum(dbl(t)).alias(f"s__{t}"), F.count(t).alias(f"n__{t}")]
    fine = written(df.groupBy(*fine_keys).agg(*aggs), "cells")
    j = fine
    for name, t, groups in specs:
        m = leave_out_group_mean_from(fine, fold_col, t, groups, name).drop(f"{name}_train_rows")
        j = j.join(written(m, "model"), [fold_col, *groups], "left")
    out = {}
    for name, _, _ in specs:
        off = F.col("my_score") - F.col(name)
        out[f"sp_{name}"] = F.col(name) * F.col("rows")
        out[f"se_{name}"] = F.when(F.col("n_score") > 0, F.col("cyy_score") + F.col("n_score") * off * off).otherwise(0.0)
    return j.select(*fine_keys, F.col("rows").alias("n"), F.col("sy_score").alias("sy"),
                    *[c.alias(k) for k, c in out.items()])


def _held_from(sums: DataFrame, fold_col: str, min_rows: int) -> DataFrame:
    """Held-out folds from a per-fold(-group) sums table (row counts add up)."""
    t = sums.groupBy(fold_col).agg(F.sum("rows").alias("fold_rows"))
    return t.where(F.col(fold_col).isNotNull() & (F.col("fold_rows") >= min_rows)).select(fold_col)


# --------------------------------------------------------------------------
# Fold-wise preprocessing (A11 median imputation, A12 standardisation).
# --------------------------------------------------------------------------

def fold_moments(df: DataFrame, fold_col: str, feats: list[str]) -> DataFrame:
    """Leave-fold-out mean and population std of every feature.

    One pass over the rows for count, mean and centred sum of squares per
    (fold, feature) (``column_moments``, without cancellation); the training rows of fold f are the merge of the folds before and after it.
    A zero (or undefined) std becomes 1.
    """
    m = column_moments(arrays(df, F.col(fold_col), feats), len(feats))
    m = written(m.select(names_of(feats).alias("feature"), "fold", "n", "m", "q"), "moments")
    rest = leave_out_moments(m, "fold", "n", ["m"], {"q": ("m", "m")}, ["feature"])
    sd = F.sqrt(F.try_divide(F.col("t_q"), F.col("t_n")))
    rest = rest.select("feature", "fold", F.when(F.col("t_n") > 0, F.col("t_m")).alias("mean"),
                       F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd).alias("std"))
    wide = rest.groupBy(F.col("fold").alias(fold_col)).pivot("feature", list(feats)).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    return wide.select(fold_col, *[F.col(f"{c}_{v}" ).alias(f"{v}__{c}") for c in feats for v in ("mean", "std")])


def scale_with(df: DataFrame, moments: DataFrame, fold_col: str, feats: list[str]) -> DataFrame:
    """Features standardised with the moments of the other folds' rows; a NULL
    fold has a row of moments like any other."""
    m = written(moments.withColumnRenamed(fold_col, "__fold"), "moments")
    j = df.join(m, F.col(fold_col).eqNullSafe(F.col("__fold")), "left").drop("__fold")
    return j.withColumns({c: (dbl(c) - F.col(f"mean__{c}")) / F.col(f"std__{c}") for c in feats}) \
            .drop(*[f"mean__{c}" for c in feats], *[f"std__{c}" for c in feats])


def _ranged(counted: DataFrame, keys, value: str) -> DataFrame:
    """Value counts in (key, value) ranges, with the number of their range."""
    return written(counted.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()), "ranges")


def _middle_values(totals: DataFrame, opened, keys, value: str) -> DataFrame:
    """Medians from range totals (*keys, part, pk).

    Running totals tell every range the ranks it holds; ``opened`` maps the
    ranges with a middle rank (at most two per group) to their rows
    (*keys, part, base, n, value, k).  Interpolation is that of Spark's
    ``percentile``.
    """
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(totals.withColumn("base", F.coalesce(F.sum("pk").over(before), F.lit(0)))
                    .withColumn("n", F.sum("pk").over(group)), "ranks")
    pos = (F.col("n") - 1) * 0.5
    lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
    rows = opened(spans.where((F.col("base") < hi) & (F.col("base") + F.col("pk") >= lo)))
    inside = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumn("cum", F.col("base") + F.sum("k").over(inside))
    two = cum.groupBy(*keys).agg(F.min(F.when(F.col("cum") >= lo, F.col(value))).alias("a"),
                                 F.min(F.when(F.col("cum") >= hi, F.col(value))).alias("b"), F.max(pos).alias("pos"))
    median = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        (F.ceil("pos") - F.col("pos")) * F.col("a") + (F.col("pos") - F.floor("pos")) * F.col("b"))
    return two.select(*keys, median.alias("median"))


def exact_medians(long: DataFrame, group_cols, value: str = "x") -> DataFrame:
    """Exact median of ``value`` per group, with no group in one task: values
    are counted with partial aggregation, the counts are cut into ranges, and
    only the ranges with a middle rank are opened."""
    keys = list(group_cols)
    counted = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"))
    ranges = _ranged(counted, keys, value)
    totals = ranges.groupBy(*keys, "part").agg(F.sum("k").alias("pk"))
    return _middle_values(totals, lambda mid: ranges.join(mid.drop("pk"), [*keys, "part"]), keys, value)


def fold_medians(df: DataFrame, fold_col: str, feats: list[str]) -> DataFrame:
    """Training-set median of every feature for every held-out fold.

    The training set of fold f is "all rows whose fold is not f" (a NULL
    fold always trains).  One pass over the facts counts every feature's rows
    per fold and range of values (the first bits of a value's sorting key, so
    what leaves a task is a table of ranges).  The training total of a range is
    its total minus fold f's, so the middle ranks of all folds come from that
    small table, and a second pass counts the values of the ranges that hold
    one.  Where such a range holds very many rows, a pass in between cuts it
    into narrower ones.  A feature without training values yields NULL.
    """
    return array_medians(arrays(df, F.col(fold_col), feats), fold_col, feats)


def array_medians(rows: DataFrame, fold_col: str, feats: list[str], nan_gone: bool = False) -> DataFrame:
    """``fold_medians`` of rows (fold, x: array of the features); ``nan_gone``: a NaN is missing."""
    folds = written(rows.where(F.col("fold").isNotNull()).select(F.col("fold").alias("held")).distinct(), "folds")
    helds = [r["held"] for r in folds.collect()]  # fold values, as many as models to fit
    if not helds:
        return folds.select(F.col("held").alias(fold_col), *[F.lit(None).cast("double").alias(f"med__{c}") for c in feats])
    medians = range_medians(rows, feats, helds, nan_gone)
    wide = medians.groupBy(F.col("held").alias(fold_col)).pivot("feature", list(feats)).agg(F.first("median"))
    # Folds whose training rows hold no value of a feature still get a row.
    out = folds.select(F.col("held").alias(fold_col)).join(wide, fold_col, "left")
    return out.select(fold_col, *[F.col(c).cast("double").alias(f"med__{c}") for c in feats])


def range_medians(rows: DataFrame, feats: list[str], helds, nan_gone: bool = False) -> DataFrame:
    """(feature, held, median) of ``columns.arrays``; a held value of None leaves out no row.

    A middle range of the first pass whose least and greatest value are equal
    (flags, sizes, prices of a few kinds) has its value; further passes only read the columns
    with a middle range of several values."""
    kind = rows.schema["fold"].dataType
    keys = ["j", "held"]
    out_of = F.array(*[F.lit(h).cast(kind) for h in helds])
    pos = (F.col("n") - 1) * 0.5
    lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
    spans, bits, opened, ends = None, 0, None, []
    while True:
        # Ranges (at last, values) below the opened ones of the step before, with the rows of every training set.
        wider, bits = bits, next(b for b in TOP_BITS if b > bits) if spans is None or most > MANY else 64
        counts = written(range_counts(rows, len(feats), bits, wider, opened, nan_gone), "ranges")
        per_held = counts.withColumn("held", F.explode(out_of)).where(F.col("held").isNull() | ~F.col("fold").eqNullSafe(F.col("held")))
        totals = per_held.groupBy(*keys, "parent", "part").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"),
                                                               F.sum("k").alias("pk"))
        if spans is not None:  # the rows before an opened range
            known = spans.select(F.col("j").alias("__j"), F.col("held").alias("__held"), F.col("part").alias("__part"), "base", "n")
            totals = totals.join(known, (F.col("j") == F.col("__j")) & F.col("held").eqNullSafe(F.col("__held")) & (F.col("parent") == F.col("__part")))
            totals = totals.drop("__j", "__held", "__part")
        else:
            totals = totals.withColumns({"base": F.lit(0).cast("long"), "n": F.sum("pk").over(Window.partitionBy(*keys))})
        before = Window.partitionBy(*keys, "parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn("base", F.col("base") + F.coalesce(F.sum("pk").over(before), F.lit(0)))
        spans = written(totals.where((F.col("base") < hi) & (F.col("base") + F.col("pk") >= lo)), "ranks")
        if wider == 0:
            single = F.col("least") == F.col("greatest")
            ends.append(spans.where(single))
            spans = spans.where(~single)
        if bits == 64:
            ends.append(spans)
            break
        found = spans.groupBy("j", "part").agg(F.max("pk").alias("pk")).collect()  # at most two a model and feature
        if not found:
            break
        opened, most = {}, max(r["pk"] for r in found)
        for r in found:
            opened.setdefault(r["j"], set()).add(r["part"])
    ends = reduce(DataFrame.unionByName, ends).withColumnRenamed("least", "x")
    end = F.col("base") + F.col("pk")
    two = ends.groupBy(*keys).agg(F.min(F.when(end >= lo, F.col("x"))).alias("a"), F.min(F.when(end >= hi, F.col("x"))).alias("b"),
                                  F.max(pos).alias("pos"))
    median = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        (F.ceil("pos") - F.col("pos")) * F.col("a") + (F.col("pos") - F.floor("pos")) * F.col("b"))
    return two.select(names_of(feats).alias("feature"), "held", median.alias("median"))


def impute_with(df: DataFrame, medians: DataFrame, fold_col: str, feats: list[str]) -> DataFrame:
    j = df.join(written(medians, "medians"), fold_col, "left")
    return j.withColumns({c: F.coalesce(dbl(c), F.col(f"med__{c}"), F.lit(0.0)) for c in feats}) \
            .drop(*[f"med__{c}" for c in feats])
