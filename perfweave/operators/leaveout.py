"""Leave-one-fold-out statistics without subtraction.

The statistics of "all folds but f" are the merge of the folds before f and
the folds after f, in some order of the folds.  Taking fold f away from a
total instead loses every digit when f is much larger than the rest, which is
the normal case of GPUs of different speed.

Tables here hold one row per fold (and partition): their size is the number
of models to fit, never the number of facts.  A NULL fold is a fold like the
others (it trains, and is never held out by the callers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leave_out_sums(table: DataFrame, fold_col: str, cols, part_cols=()) -> DataFrame:
    """Add ``t_<c>``: the sum of the other folds' ``c`` (0 without any) per partition."""
    part = [F.col(p) for p in part_cols] or [F.lit(0)]
    fold = F.col(fold_col)
    before = Window.partitionBy(*part).orderBy(fold.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*part).orderBy(fold.desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = {c: F.lit(0).cast(table.schema[c].dataType) for c in cols}
    return table.withColumns({f"t_{c}": F.coalesce(F.sum(c).over(before), zero[c]) + F.coalesce(F.sum(c).over(after), zero[c])
                              for c in cols})


def leave_out_extremes(table: DataFrame, fold_col: str, lows, highs, part_cols=()) -> DataFrame:
    """Add ``t_<c>``: the least (``lows``) or greatest (``highs``) value of the other folds per partition."""
    part = [F.col(p) for p in part_cols] or [F.lit(0)]
    fold = F.col(fold_col)
    before = Window.partitionBy(*part).orderBy(fold.asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*part).orderBy(fold.desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return table.withColumns({f"t_{c}": pick(of(c).over(before), of(c).over(after))
                              for cs, of, pick in ((lows, F.min, F.least), (highs, F.max, F.greatest)) for c in cs})


def merge_moments(a: Column, b: Column, count: str, means, products: dict, cubes: dict | None = None) -> Column:
    """Moments of two disjoint sets of rows as those of their union: count,
    means, centred sums of products of two of the means' columns, and centred
    sums of cubes (``cubes``: name -> (mean, its square sum))."""
    n = a[count] + b[count]
    share = F.when(n > 0, b[count] / n).otherwise(F.lit(0.0))
    off = {m: b[m] - a[m] for m in means}
    rest = F.when(n > 0, a[count] / n).otherwise(F.lit(0.0))
    return F.struct(n.alias(count), *[(a[m] + off[m] * share).alias(m) for m in means],
                    *[(a[p] + b[p] + off[x] * off[y] * a[count] * share).alias(p) for p, (x, y) in products.items()],
                    *[(a[t] + b[t] + off[m] * off[m] * off[m] * a[count] * share * (rest - share)
                       + 3.0 * off[m] * (rest * b[q] - share * a[q])).alias(t) for t, (m, q) in (cubes or {}).items()])


def leave_out_moments(table: DataFrame, fold_col: str, count: str, means, products: dict, part_cols=(),
                      cubes: dict | None = None) -> DataFrame:
    """Per (partition, fold): ``t_<column>`` of the merged other folds.

    The folds of a partition (one small row each) form an array; one scan from
    the front and one from the back hold the merges of every prefix and
    suffix, and fold f takes the prefix that ends before it and the suffix
    that begins after it.  Missing moments count as those of no rows.
    """
    names = [count, *means, *products, *(cubes or {})]
    item = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    folds = table.groupBy(*part_cols).agg(F.sort_array(F.collect_list(F.struct(F.col(fold_col).alias("fold"), item.alias("m")))).alias("fs")).where(
        F.size("fs") > 0)
    none = F.array(F.struct(*[F.lit(0.0).alias(c) for c in names]))

    def scan(items: Column) -> Column:
        return F.aggregate(items, none, lambda acc, x: F.concat(acc, F.array(
            merge_moments(F.element_at(acc, -1), x["m"], count, means, products, cubes))))

    folds = folds.withColumns({"front": scan(F.col("fs")), "back": scan(F.reverse("fs")), "k": F.size("fs")})
    rows = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(
        F.get("fs", i)["fold"].alias(fold_col),
        merge_moments(F.get("front", i), F.get("back", F.col("k") - 1 - i), count, means, products, cubes).alias("t")))
    out = folds.select(*part_cols, F.explode(rows).alias("r"))
    return out.select(*part_cols, f"r.{fold_col}", *[F.col(f"r.t.{c}").alias(f"t_{c}") for c in names])
