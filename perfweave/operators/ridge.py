"""Leave-fold-out ridge regression on the whole feature matrix (M6c inside M3/M4).

All folds' models come from one blocked Gram aggregate.  A row is the vector
[u | m | y]: u_i is the feature's distance from a centre where it is present
and 0 where it is missing, m_i is 1 where it is missing, y are the targets.
In one pass every task merges the moments of its batches per fold (counts,
means and products of deviations from them, no subtraction) and sends them in
BLOCK x BLOCK blocks of columns, so nothing that travels or is merged between
tasks is as wide as the matrix.  The folds but f are merged from the front
and the back.

The matrix is written once, a row's features as one binary cell of doubles
(NaN: missing): it is read by every later pass, and a cell of bytes is copied
whole where an array goes number by number.  Since an imputed feature is
centre + u + (median - centre) m, its mean, spread and products with any other
follow from the merged moments for whatever median: imputing with the
training median (A11), standardising with training moments (A12) and fitting
need no further pass.

Only the last step holds a whole p x p matrix: one task solves the normal
equations of one fold.  p is the number of feature columns, so that is a
property of the schema, not of the data; there is no cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import dbl
from ..session import code_on_workers
from ..storage import written
from .columns import numbered, numbers
from .predict import array_medians

BLOCK = 64
CONSTANT = 1e-20  # a variance below this share of the squared size is rounding


def packed(df: DataFrame, feats, keep) -> DataFrame:
    """``keep`` columns and ``__x``: the features of a row as the bytes of doubles, NaN for a missing one."""
    import pyarrow as pa

    width = 8 * len(feats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(b.column("__x").flatten().to_numpy(zero_copy_only=False), float)
            ends = pa.py_buffer(np.arange(len(b) + 1, dtype=np.int32) * np.int32(width))
            cells = pa.Array.from_buffers(pa.binary(), len(b), [None, ends, pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), cells], names=[*keep, "__x"])

    wide = df.select(*keep, F.array(*[F.coalesce(dbl(c), F.lit(float("nan"))) for c in feats]).alias("__x"))
    return wide.mapInArrow(run, T.StructType([*wide.select(*keep).schema.fields, T.StructField("__x", T.BinaryType())]))


def _vectors(b, centres: np.ndarray, p: int) -> np.ndarray:
    """[u | m | y] of a batch with the cell x (features; NaN: missing) and the targets in the columns behind it."""
    f = numbers(b.column("x"), p)
    gone = np.isnan(f)
    z = np.empty((len(b), 2 * p + len(centres) - p))
    np.subtract(f, centres[:p], out=z[:, :p])
    z[:, :p][gone] = 0.0
    z[:, p:2 * p] = gone
    for i, c in enumerate(centres[p:]):
        z[:, 2 * p + i] = b.column(2 + i).to_numpy(zero_copy_only=False) - c
    return z


def fold_grams(rows: DataFrame, centres, p: int, block: int = BLOCK) -> DataFrame:
    """(fold, bi, bj, n, mi, mj, c): per fold and pair of column blocks the row
    count, the means of both blocks and the sums of products of deviations.

    ``rows``: (fold, x, targets...); rows with a missing target must not be in it.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    rows_kind = to_arrow_type(rows.schema["fold"].dataType)
    centres = np.asarray(centres, float)
    width = 2 * p + len(centres) - p
    spans = [(a, min(a + block, width)) for a in range(0, width, block)]
    kind = rows.schema["fold"].dataType.simpleString()
    names = ["fold", "bi", "bj", "n", "mi", "mj", "c"]
    near = ["hi", "hj"]  # values close to the means: these are kept as distances from them until all parts are merged

    def sent(items, more=()):
        """A record batch of (fold, bi, bj, n, mi, mj, c, more...)."""
        kinds = (rows_kind, pa.int32(), pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * (3 + len(more)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in items], k) for i, k in enumerate(kinds)], names=[*names, *more])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        close: dict = {}
        got: dict = {}
        for b in batches:
            if not len(b):
                continue
            z, at = _vectors(b, centres, p), numbered(b, known)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(known)))
            for f, v in enumerate(np.split(order, ends[:-1])):
                if len(v):
                    d = z[v]
                    d -= close.setdefault(f, d.mean(0))
                    mean = d.mean(0)
                    d -= mean
                    part = (float(len(v)), mean, mean, d.T @ d)
                    got[f] = _merge(got[f], part) if f in got else part
        for v, f in known.items():
            n, m, _, x = got[f]
            yield sent([(v, i, j, n, m[a:e], m[c:g], x[a:e, c:g].ravel(), close[f][a:e], close[f][c:g])
                        for i, (a, e) in enumerate(spans) for j, (c, g) in enumerate(spans) if j >= i], near)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close: dict = {}
        got: dict = {}
        for b in batches:
            for v, i, j, n, mi, mj, x, hi, hj in zip(*(b.column(c).to_pylist() for c in names[:4]), *(_lists(b.column(c)) for c in [*names[4:], *near])):
                key, x = (v, i, j), x.reshape(len(mi), len(mj))
                if key in got:
                    got[key] = _merge(got[key], (n, mi + (hi - close[key][0]), mj + (hj - close[key][1]), x))
                else:
                    got[key], close[key] = (n, mi, mj, x), (hi, hj)
        for key, (n, mi, mj, x) in got.items():
            yield sent([(*key, n, close[key][0] + mi, close[key][1] + mj, x.ravel())])

    schema = f"fold {kind}, bi int, bj int, n double, mi array<double>, mj array<double>, c array<double>"
    parts = rows.mapInArrow(products, schema + "".join(f", {c} array<double>" for c in near))
    return parts.repartition("fold", "bi", "bj").mapInArrow(merged, schema)


def _lists(column) -> list[np.ndarray]:
    """The cells of a column of lists."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return np.split(flat, ends[1:-1] - ends[0])


def _merge(a, b):
    """Moments of two disjoint sets of rows as those of their union."""
    n = a[0] + b[0]
    if n == 0:
        return a
    w = b[0] / n
    di, dj = b[1] - a[1], b[2] - a[2]
    return n, a[1] + w * di, a[2] + w * dj, a[3] + b[3] + np.outer(di, dj) * (a[0] * w)


def leave_out_grams(grams: DataFrame) -> DataFrame:
    """The same columns for every fold, of the other folds' rows together; one
    task holds one pair of column blocks of all folds."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        items, m = sorted(f.itertuples(index=False), key=lambda r: str(r.fold)), []
        for r in items:
            mi, mj = np.array(r.mi), np.array(r.mj)
            m.append((r.n, mi, mj, np.array(r.c).reshape(len(mi), len(mj))))
        none = (0.0, np.zeros_like(m[0][1]), np.zeros_like(m[0][2]), np.zeros_like(m[0][3]))
        front, back = [none], [none]
        for x in m:
            front.append(_merge(front[-1], x))
        for x in reversed(m):
            back.append(_merge(back[-1], x))
        out = []
        for k, r in enumerate(items):
            n, mi, mj, c = _merge(front[k], back[len(m) - 1 - k])
            out.append((r.fold, r.bi, r.bj, n, mi.tolist(), mj.tolist(), c.ravel().tolist()))
        return pd.DataFrame(out, columns=["fold", "bi", "bj", "n", "mi", "mj", "c"])

    return grams.groupBy("bi", "bj").applyInPandas(run, grams.schema)


def solve(mean: np.ndarray, cov: np.ndarray, target: float, cross: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of ridge on standardised features with penalty ``lam``."""
    var = np.diag(cov)
    sd = np.sqrt(np.where(var > CONSTANT * (mean * mean + var), var, 1.0))
    use = var > CONSTANT * (mean * mean + var)
    corr = cov / np.outer(sd, sd)
    corr[~use], corr[:, ~use] = 0.0, 0.0
    beta = np.where(use, np.linalg.solve(corr + lam * np.eye(len(mean)), np.where(use, cross / sd, 0.0)), 0.0) / sd
    return float(target - mean @ beta), beta


def models(grams: DataFrame, medians: DataFrame, feats, centres, specs, lam: float) -> DataFrame:
    """(fold, fill, <name>_a, <name>_b): per held-out fold the training medians and every spec's coefficients.

    ``grams``: left-out moments; ``medians``: (fold, med array)."""
    import pandas as pd

    p, centres = len(feats), np.asarray(centres, float)
    at = {c: i for i, c in enumerate(feats)}
    subsets = [np.array([at[c] for c in fs]) for _, fs, _ in specs]
    width = 2 * p + len(centres) - p

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if not f["n"].iloc[0] > 0:  # no training row
            return pd.DataFrame([(f["fold"].iloc[0], [0.0] * p, *[x for _ in specs for x in (None, [0.0] * p)])], columns=names)
        step = max(len(r.mi) for r in f.itertuples())
        mean, c = np.zeros(width), np.zeros((width, width))
        for r in f.itertuples():
            i, j = slice(r.bi * step, r.bi * step + len(r.mi)), slice(r.bj * step, r.bj * step + len(r.mj))
            mean[i], mean[j] = r.mi, r.mj
            c[i, j] = np.array(r.c).reshape(len(r.mi), len(r.mj))
            c[j, i] = c[i, j].T
        n = float(f["n"].iloc[0])
        med = np.array([np.nan if v is None else v for v in f["med"].iloc[0]], float)
        fill = np.where(np.isnan(med), 0.0, med)  # no training value: the whole column is 0
        # Imputed features: centre + u + (fill - centre) m.
        t = np.hstack([np.eye(p), np.diag(fill - centres[:p])])
        x_mean = centres[:p] + t @ mean[:2 * p]
        cov = t @ c[:2 * p, :2 * p] @ t.T / n
        row = [f["fold"].iloc[0], fill.tolist()]
        for s, subset in enumerate(subsets):
            k = 2 * p + s
            a, beta = solve(x_mean[subset], cov[np.ix_(subset, subset)], centres[p + s] + mean[k], (t @ c[:2 * p, k] / n)[subset], lam)
            b = np.zeros(p)
            b[subset] = beta
            row += [a, b.tolist()]
        return pd.DataFrame([row], columns=names)

    names = ["fold", "fill", *[f"{n}_{x}" for n, _, _ in specs for x in "ab"]]
    kind = grams.schema["fold"].dataType.simpleString()
    schema = f"fold {kind}, fill array<double>, " + ", ".join(f"{n}_a double, {n}_b array<double>" for n, _, _ in specs)
    both = grams.join(medians.withColumnRenamed("fold", "f"), F.col("fold") == F.col("f")).drop("f")
    return both.groupBy("fold").applyInPandas(run, schema)


def scored(table: DataFrame, fitted: DataFrame, columns, names) -> DataFrame:
    """The rows (columns, with __fold and __x) of the folds that have a model, with its predictions in the place of __x.

    ``fitted``: the rows of ``models``; folds x features numbers go to every task."""
    import pyarrow as pa

    rows = table.select(*columns)
    known = {r["fold"]: (np.array(r["fill"]), [(r[f"{n}_a"], np.array(r[f"{n}_b"])) for n in names]) for r in fitted.collect()}
    shared = table.sparkSession.sparkContext.broadcast(known)
    others = [f for f in rows.schema.fields if f.name != "__x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds: dict = {}
            at = numbered(b.select(["__fold"]).rename_columns(["fold"]), folds)
            held = np.isin(at, [f for v, f in folds.items() if v in shared.value])
            if not held.any():
                continue
            if not held.all():
                b, at = b.filter(pa.array(held)), at[held]
            out, known_here = np.zeros((len(names), len(b))), np.ones((len(names), len(b)), bool)
            x = None
            for v, f in folds.items():
                mine = np.flatnonzero(at == f)
                if not len(mine):
                    continue
                fill, fits = shared.value[v]
                x = numbers(b.column("__x"), len(fill)) if x is None else x
                full = x[mine]
                full = np.where(np.isnan(full), fill, full)
                for s, (a, beta) in enumerate(fits):
                    if a is None:  # no training row
                        known_here[s, mine] = False
                    else:
                        out[s, mine] = a + full @ beta
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in others], *[pa.array(o, pa.float64(), mask=~k) for o, k in zip(out, known_here)]],
                                             names=[*[f.name for f in others], *names])

    return rows.mapInArrow(run, T.StructType([*others, *[T.StructField(n, T.DoubleType()) for n in names]]))


def oof_ridge(df: DataFrame, fold_col: str, specs, keys, lam: float = 1.0, min_rows: int = 1, block: int = BLOCK) -> DataFrame:
    """Out-of-fold ridge predictions; specs = [(name, features, target)].

    Returns ``keys``, fold, targets and one column a spec for the rows of
    held-out folds (not NULL, at least ``min_rows`` rows).  Rows without a
    target train no model but are predicted.  Missing features are imputed
    with the training median, all features standardised with training moments.
    """
    spark = df.sparkSession
    code_on_workers(spark)
    feats = list(dict.fromkeys(c for _, fs, _ in specs for c in fs))
    targets = [t for _, _, t in specs]
    keep = list(dict.fromkeys([*keys, fold_col, *targets]))
    ys = [f"__y{i}" for i in range(len(targets))]
    slim = df.withColumns({"__fold": F.col(fold_col), **{y: dbl(t) for y, t in zip(ys, targets)}})
    table = written(packed(slim, feats, [*keep, "__fold", *ys]), "matrix")
    whole = F.lit(True)
    for i in range(len(targets)):
        whole = whole & F.col(f"__y{i}").isNotNull()
    training = table.where(whole)
    meds = written(array_medians(training.select(F.col("__fold").alias("fold"), F.col("__x").alias("x")), "fold", feats, nan_gone=True), "medians")
    rows = meds.collect()  # folds x features numbers
    centres = [median(v) if (v := [r[f"med__{c}"] for r in rows if r[f"med__{c}"] is not None]) else 0.0 for c in feats]
    y_mean = training.agg(*[F.coalesce(F.avg(f"__y{i}"), F.lit(0.0)) for i in range(len(targets))]).collect()[0]
    centres += [float(v) for v in y_mean]
    x = training.select(F.col("__fold").alias("fold"), F.col("__x").alias("x"), *ys)
    grams = written(fold_grams(x, centres, len(feats), block), "grams")
    fitted = models(leave_out_grams(grams).where(F.col("fold").isNotNull()),
                    meds.select("fold", F.array(*[F.col(f"med__{c}") for c in feats]).alias("med")), feats, centres, specs, lam)
    held = table.groupBy(F.col("__fold").alias("h")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("h").isNotNull() & (F.col("rows") >= min_rows))
    fitted = written(fitted.join(held, F.col("fold") == F.col("h"), "left_semi"), "model")
    return scored(table, fitted, [*keep, "__fold", "__x"], [n for n, _, _ in specs]).select(*keep, *[n for n, _, _ in specs])
