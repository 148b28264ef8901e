"""Statistics of many columns in one pass, without unpivoting the rows.

A row goes to the Python side as one array of doubles; a task sums a batch with
numpy, a column at a time or all together, and sends one row per (fold, column)
or per (fold, column, range) at its end.  Spark merges those.  The rows
themselves are neither exploded nor shuffled, so a pass costs the projection
of its columns plus a few operations a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import dbl
from ..session import code_on_workers, jit_sized_methods
from .leaveout import merge_moments

PRODUCTS, CUBES = {"q": ("m", "m")}, {"t": ("m", "q")}
TOP_BITS = (18, 40, 64)    # of a value's sorting key: sign, exponent and 6 bits, then 22 more, then all
MANY = 1_000_000           # rows of a range above which the next key bits are counted before its values
GONE = np.uint64(2 ** 64 - 1)  # key of a missing value: greater than that of any number or NaN
HELD = 1_000_000         # counters that a task holds before it merges, and half of it before it sends them


def arrays(df: DataFrame, fold, values) -> DataFrame:
    """(fold, x): the values of a row as one array of doubles."""
    code_on_workers(df.sparkSession)
    jit_sized_methods(df.sparkSession)
    return df.select(fold.alias("fold"), F.array(*[dbl(v) for v in values]).alias("x"))


def numbers(column, p: int) -> np.ndarray:
    """Rows by p doubles of a column of arrays or of binary cells (the bytes of p doubles); read only."""
    import pyarrow as pa

    if not pa.types.is_binary(column.type):
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), p)
    if not len(column):
        return np.zeros((0, p))
    first = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]
    return np.frombuffer(column.buffers()[2], np.uint8, 8 * len(column) * p, first).view(np.float64).reshape(len(column), p)


def read_batch(b, p: int):
    """(values, missing) of a batch, rows by columns; a NaN is a value, a null is missing."""
    import pyarrow as pa

    if pa.types.is_binary(b.column("x").type):
        x = numbers(b.column("x"), p)
        return x, np.zeros(x.shape, bool)
    flat = b.column("x").flatten()
    x = np.array(flat.to_numpy(zero_copy_only=False), float).reshape(len(b), p)
    if not flat.null_count:
        return x, np.zeros(x.shape, bool)
    return x, flat.is_null().to_numpy(zero_copy_only=False).reshape(len(b), p)


def numbered(b, known: dict) -> np.ndarray:
    """The folds of a batch as numbers; ``known`` maps fold values to them and grows."""
    coded = b.column("fold").dictionary_encode(null_encoding="encode")
    numbers = np.array([known.setdefault(v, len(known)) for v in coded.dictionary.to_pylist()], np.int64)
    return numbers[coded.indices.to_numpy(zero_copy_only=False)]


# ------------------------------------------------------------------ moments ---

def block_moments(x: np.ndarray, gone: np.ndarray) -> dict:
    """Moments of the columns of a block.  Distances from a value of the column
    are summed, so equal values have no spread at all."""
    n = (len(x) - gone.sum(0)).astype(float)
    first = np.where(n > 0, x[(~gone).argmax(0), np.arange(x.shape[1])], 0.0)
    shift = np.where(gone, 0.0, x - first)
    mean = shift.sum(0) / np.maximum(n, 1.0)
    d = np.where(gone, 0.0, shift - mean)
    square = d * d
    x = np.where(gone, 0.0, x)
    some = lambda v: np.where(np.isfinite(v) | np.isnan(v), v, np.nan)
    return {"n": n, "m": first + mean, "q": square.sum(0), "t": (square * d).sum(0), "rows": np.full(x.shape[1], len(x), np.int64),
            "non01": ((x != 0) & (x != 1)).sum(0), "negative": (x < 0).sum(0), "lo": some(np.where(gone, np.inf, x).min(0)),
            "lo_pos": some(np.where(x > 0, x, np.inf).min(0)), "hi": some(np.where(gone, -np.inf, x).max(0))}


def merged_blocks(a: dict, b: dict) -> dict:
    n = a["n"] + b["n"]
    some = np.maximum(n, 1.0)
    share, rest, off = b["n"] / some, a["n"] / some, np.where((a["n"] > 0) & (b["n"] > 0), b["m"] - a["m"], 0.0)
    out = {"n": n, "m": np.where(a["n"] > 0, a["m"] + off * share, b["m"]), "q": a["q"] + b["q"] + off * off * a["n"] * share,
           "t": a["t"] + b["t"] + off * off * off * a["n"] * share * (rest - share) + 3.0 * off * (rest * b["q"] - share * a["q"])}
    out.update({c: a[c] + b[c] for c in ("rows", "non01", "negative")})
    out.update({c: f(a[c], b[c]) for c, f in (("lo", np.fmin), ("lo_pos", np.fmin), ("hi", np.fmax))})
    return out


def column_moments(rows: DataFrame, p: int) -> DataFrame:
    """(j, fold, n, rows, m, q, t, non01, negative, lo, lo_pos, hi) of ``arrays``:
    per fold and column the values and rows, mean, centred sums of squares and
    cubes, values other than 0 and 1, negative ones, least, least positive and
    greatest value."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind, fold_kind = rows.schema["fold"].dataType.simpleString(), to_arrow_type(rows.schema["fold"].dataType)
    doubles, longs = ("n", "m", "q", "t", "lo", "lo_pos", "hi"), ("rows", "non01", "negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        state: dict = {}
        with np.errstate(all="ignore"):
            for b in batches:
                if not len(b):
                    continue
                x, gone = read_batch(b, p)
                at = numbered(b, known)
                for f in np.unique(at):
                    mine = slice(None) if len(known) == 1 else at == f
                    part = block_moments(x[mine], gone[mine])
                    state[f] = merged_blocks(state[f], part) if f in state else part
        for v, f in known.items():
            s = state[f]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * p, fold_kind), pa.array(np.arange(p, dtype=np.int32)),
                 *[pa.array(s[c], pa.float64(), mask=np.isnan(s[c]) if c in ("lo", "lo_pos", "hi") else None) for c in doubles],
                 *[pa.array(s[c].astype(np.int64)) for c in longs]], names=["fold", "j", *doubles, *longs])

    parts = rows.mapInArrow(run, f"fold {kind}, j int, " + ", ".join(f"{c} double" for c in doubles) + ", " + ", ".join(f"{c} long" for c in longs))
    names = ("n", "m", "q", "t")
    none = F.struct(*[F.lit(0.0).alias(c) for c in names])
    whole = parts.groupBy("j", "fold").agg(
        F.sort_array(F.collect_list(F.struct(*names))).alias("parts"), *[F.sum(c).alias(c) for c in longs],  # one a task
        F.min("lo").alias("lo"), F.min("lo_pos").alias("lo_pos"), F.max("hi").alias("hi"))
    both = F.aggregate("parts", none, lambda acc, v: merge_moments(acc, v, "n", ["m"], PRODUCTS, CUBES))
    return whole.withColumn("all", both).select("j", "fold", *[F.col(f"all.{c}").alias(c) for c in names], *longs, "lo", "lo_pos", "hi")


def names_of(columns, at="j") -> F.Column:
    """Column name of a number."""
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(at) + 1)


# ------------------------------------------------------------- value ranges ---

def sorting_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort like the values; -0.0 is 0.0, NaN is the greatest."""
    x = x + 0.0
    x[np.isnan(x)] = np.nan
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def values_of(keys: np.ndarray) -> np.ndarray:
    bits = np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys)
    return bits.view(np.float64)


def top_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of a key as a long that sorts like it."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits < 64 else (keys ^ np.uint64(1 << 63)).view(np.int64)


def _summed(cells):
    """Counters (column, fold, key, least, greatest, rows) with those of one column, fold and key merged."""
    j, f, key, lo, hi, k = (np.concatenate(c) for c in zip(*cells))
    if not len(j):
        return j, f, key, lo, hi, k
    order = np.lexsort((key, f, j))
    j, f, key, lo, hi, k = (v[order] for v in (j, f, key, lo, hi, k))
    new = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (f[1:] != f[:-1]) | (key[1:] != key[:-1])]))
    return j[new], f[new], key[new], np.minimum.reduceat(lo, new), np.maximum.reduceat(hi, new), np.add.reduceat(k, new)


def block_counts(keys: np.ndarray, bits: int):
    """(column, first ``bits``, least, greatest key, rows) of a block of keys, columns by rows; GONE counts nowhere."""
    keys = np.sort(keys, axis=1)
    top = keys >> np.uint64(64 - bits) if bits < 64 else keys
    first = np.ones(keys.shape, bool)
    first[:, 1:] = top[:, 1:] != top[:, :-1]
    at = np.flatnonzero(first)
    end = np.append(at[1:], keys.size)
    lo = keys.ravel()[at]
    some = lo != GONE
    at, end = at[some], end[some]
    return at // keys.shape[1], top.ravel()[at], lo[some], keys.ravel()[end - 1], end - at


def range_counts(rows: DataFrame, p: int, bits: int, above: int = 0, opened: dict | None = None, nan_gone: bool = False) -> DataFrame:
    """(j, fold, part, parent, least, greatest, k): rows per fold, column and first
    ``bits`` of the value's key, with the least and greatest value there; with
    ``opened`` (column -> numbers of its ranges at ``above`` bits) only in those
    ranges, and only their columns are read.  ``nan_gone``: a NaN is missing.  A
    task adds up what it reads and sends it when it holds too many counters."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind, fold_kind = rows.schema["fold"].dataType.simpleString(), to_arrow_type(rows.schema["fold"].dataType)
    ranges, at_hand, picked = None, np.arange(p, dtype=np.int32), None
    if opened is not None:
        at_hand = np.array(sorted(opened), np.int32)
        ranges = [np.array(sorted(opened[j]), np.int64) for j in at_hand.tolist()]
        if isinstance(rows.schema["x"].dataType, T.BinaryType):
            picked = at_hand  # cells come whole
        else:
            p = len(at_hand)
            rows = rows.select("fold", F.array(*[F.get("x", F.lit(j)) for j in at_hand.tolist()]).alias("x"))
    schema = f"j int, fold {kind}, part long, parent long, least double, greatest double, k long"

    def send(cells, known):
        j, f, key, lo, hi, k = _summed(cells)
        keys = key << np.uint64(64 - bits) if bits < 64 else key
        yield pa.RecordBatch.from_arrays(
            [pa.array(at_hand[j]), pa.array(list(known), fold_kind).take(pa.array(f)), pa.array(top_of(keys, bits)),
             pa.array(top_of(keys, above) if above else np.zeros(len(j), np.int64)),
             pa.array(values_of(lo)), pa.array(values_of(hi)), pa.array(k)],
            names=["j", "fold", "part", "parent", "least", "greatest", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        cells, held = [], 0
        for b in batches:
            if not len(b):
                continue
            x, gone = read_batch(b, p)
            if picked is not None:
                x, gone = x[:, picked], gone[:, picked]
            at = numbered(b, known)
            order = np.argsort(at, kind="stable")
            x, gone = np.ascontiguousarray(x[order].T), gone[order].T
            keys = sorting_keys(x)
            keys[gone | np.isnan(x) if nan_gone else gone] = GONE
            for j, inside in enumerate(ranges or ()):
                keys[j, ~np.isin(top_of(keys[j], above), inside)] = GONE
            folds, starts = np.unique(at[order], return_index=True)
            for f, a, e in zip(folds, starts, [*starts[1:], len(at)]):
                j, *rest, k = block_counts(keys[:, a:e], bits)
                cells.append((j, np.full(len(j), f), *rest, k))
                held += len(j)
            if held > HELD:
                cells = [_summed(cells)]
                held = len(cells[0][0])
                if held > HELD // 2:
                    yield from send(cells, known)
                    cells, held = [], 0
        if cells:
            yield from send(cells, known)

    return rows.mapInArrow(run, schema).groupBy("j", "fold", "part", "parent").agg(
        F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("k").alias("k"))
