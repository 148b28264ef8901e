"""Whole-number vectors with exact inner products, shared by the vector operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
HUGE = 1e100  # from here on squares of components may not be finite


def whole_numbers(embedding: Column, scale: int) -> tuple[Column, Column]:
    """(whether a vector takes part, floor(scale * x) of its components as doubles).

    No part take null vectors and null or non-finite components, nor those
    whose product with ``scale`` is not finite.
    """
    scaled = F.transform(embedding, lambda x: F.lit(float(scale)) * x.cast("double"))
    sound = embedding.isNotNull() & F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a long and would be cut at its ends; from 2**52 on a double is whole anyway.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    return F.coalesce(sound, F.lit(False)), whole


def width_and_unit(rows: DataFrame) -> tuple[int, float]:
    """Longest vector of a column v, and a unit for distances in which squares stay finite (scores need none)."""
    one = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"),
                   F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("largest")).collect()[0]
    return max(1, one["width"]), 1.0 if (one["largest"] or 0.0) < HUGE else one["largest"]


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences (no cancellation of large squares)."""
    out = np.empty((len(x), len(points)))
    for i, p in enumerate(points):
        d = x - p
        out[:, i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors: int64, exact, cut to the range of a long.

    Where the lengths prove every partial sum below 2**53, doubles are exact; the rest is added in whole numbers of any size."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    with np.errstate(over="ignore"):
        small = np.sqrt(np.einsum("ij,ij->i", q, q).max()) * np.sqrt(np.einsum("ij,ij->i", x, x)) < float(1 << 53)
    if small.all():
        return (q @ x.T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    out[:, small] = (q @ x[small].T).astype(np.int64)
    a, b = ([[int(v) for v in row] for row in m.tolist()] for m in (q, x[~small]))
    out[:, ~small] = [[min(max(sum(s * t for s, t in zip(u, v)), LONG_MIN), LONG_MAX) for v in b] for u in a]
    return out


def pack(sizes: dict, most: int) -> tuple[dict, dict]:
    """First bin and number of bins of every key: neighbours share a bin up to ``most``, a larger key has several."""
    first, cuts, at, room = {}, {}, -1, 0
    for u in sorted(sizes):
        n = sizes[u]
        if n > most:
            cuts[u] = -(-n // most)
            first[u], at, room = at + 1, at + cuts[u], 0
        else:
            if n > room or at < 0:
                at, room = at + 1, most
            first[u], cuts[u], room = at, 1, room - n
    return first, cuts


def look_up(table: dict, column, default: int = 1) -> Column:
    """The value of a small dictionary for a column."""
    if not table:
        return F.lit(default)
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), column)
