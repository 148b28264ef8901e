"""Missing-value safe scalar expressions.

The source workflow has one missing value (IEEE NaN) that propagates through
arithmetic; Spark has NULL, and ``greatest``/``least`` *skip* NULL.  Every
clamp below is guarded so a missing input stays missing.  Ingest converts NaN
and +/-inf to NULL once (``canon_missing``); everything after uses NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col_(c).cast("double")


def guarded_max(lo: float, c) -> Column:
    """``max(lo, c)`` that keeps a missing ``c`` missing."""
    c = dbl(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), c))


def safe_ratio(num, den, floor: float = 1e-9) -> Column:
    """``num / max(floor, den)``; missing in either side gives missing."""
    return dbl(num) / guarded_max(floor, den)


def clip01(c) -> Column:
    """``min(1, max(0, c))`` with missing kept missing."""
    c = dbl(c)
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def finite_or_null(c) -> Column:
    """NaN, +inf and -inf become NULL."""
    c = dbl(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def is_truthy(c) -> Column:
    """Lower-cased text in {true, 1, yes} -> 1, anything else (incl. missing) -> 0."""
    s = F.lower(col_(c).cast("string"))
    return F.coalesce(s.isin("true", "1", "yes"), F.lit(False)).cast("int")


def as_category(c) -> Column:
    """String form of a categorical value; missing is its own category 'nan'."""
    return F.coalesce(col_(c).cast("string"), F.lit("nan"))


def contains_any(c, keys) -> Column:
    """Lower-cased substring test against any of ``keys`` (X5); missing -> false."""
    s = F.lower(F.coalesce(col_(c).cast("string"), F.lit("nan")))
    out = F.lit(False)
    for k in keys:
        out = out | s.contains(k)
    return out


def numeric_columns(df: DataFrame, include_bool: bool = True) -> list[str]:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES) or (
                include_bool and isinstance(f.dataType, T.BooleanType)):
            out.append(f.name)
    return out


def canon_missing(df: DataFrame, cols=None, skip=()) -> DataFrame:
    """Turn NaN/inf into NULL in floating columns, in one projection."""
    floating = {f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    targets = [c for c in (cols or floating) if c in floating and c not in skip]
    if not targets:
        return df
    return df.withColumns({c: finite_or_null(c) for c in targets})
