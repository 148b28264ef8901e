"""Passes of the ridge over its written matrix: packed cells, products in one pass, no features in the scores."""

import numpy as np
from pyspark.sql import functions as F

from perfweave.operators import columns, ridge


def _rows(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(300, 5)) + [1e9, 0.0, -3.0, 5.0, 0.1], rng.normal(size=300)
    x[rng.random(x.shape) < 0.2] = np.nan
    fold = [None if i % 7 == 0 else i % 3 for i in range(300)]
    rows = [(f, float(t), *[None if np.isnan(v) else float(v) for v in r]) for f, t, r in zip(fold, y, x)]
    df = spark.createDataFrame(rows, "fold int, y double, a double, b double, c double, d double, e double").repartition(6)
    return df, np.array([-1 if f is None else f for f in fold]), x, y


def test_products_of_packed_rows_from_parts_of_tasks(spark):
    df, fold, x, y = _rows(spark)
    cells = ridge.packed(df, list("abcde"), ["fold", "y"]).select("fold", F.col("__x").alias("x"), "y")
    assert cells.schema["x"].dataType.simpleString() == "binary"
    centres = [1e9, 0.0, -3.0, 5.0, 0.1, 0.0]
    grams = ridge.fold_grams(cells, centres, 5, block=4).collect()
    assert len(grams) == 4 * 6  # folds x pairs of blocks
    gone = np.isnan(x)
    z = np.hstack([np.where(gone, 0.0, x - centres[:5]), gone, y[:, None]])
    for r in grams:
        v = z[fold == (-1 if r["fold"] is None else r["fold"])]
        i, j = (v[:, 4 * r[b]:4 * r[b] + 4] for b in ("bi", "bj"))
        assert r["n"] == len(v)
        np.testing.assert_allclose(r["mi"], i.mean(0), rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(np.reshape(r["c"], (i.shape[1], -1)), (i - i.mean(0)).T @ (j - j.mean(0)), rtol=1e-9, atol=1e-9)


def test_range_counts_of_packed_rows(spark):
    """Cells of bytes give the counts that arrays give, also where only some columns are opened."""
    df, *_ = _rows(spark)
    nan = F.lit(float("nan"))
    arrays = df.select("fold", F.array(*[F.coalesce(F.col(c), nan) for c in "abcde"]).alias("x"))
    cells = ridge.packed(df, list("abcde"), ["fold"]).select("fold", F.col("__x").alias("x"))
    first = columns.range_counts(arrays, 5, 18, nan_gone=True).collect()
    opened = {}
    for r in first:
        if r["j"] in (1, 3):
            opened.setdefault(r["j"], set()).add(r["part"])
    for args in ((18,), (64, 18, opened)):
        a, b = (sorted((tuple(r) for r in columns.range_counts(rows, 5, *args, nan_gone=True).collect()), key=str) for rows in (arrays, cells))
        assert a == b and a


def test_scored_rows_do_not_carry_the_matrix(spark):
    df, fold, x, _ = _rows(spark)
    table = ridge.packed(df, list("abcde"), ["fold", "y"]).withColumn("__fold", F.col("fold"))
    fitted = spark.createDataFrame([(0, [1.0] * 5, 2.0, [0.0, 1.0, 1.0, 0.0, 0.0])], "fold int, fill array<double>, p_a double, p_b array<double>")
    out = ridge.scored(table, fitted, ["y", "__fold", "__x"], ["p"])
    assert out.columns == ["y", "__fold", "p"]
    full = np.where(np.isnan(x), 1.0, x)[fold == 0]
    assert np.allclose(sorted(r["p"] for r in out.collect()), sorted(2.0 + full[:, 1] + full[:, 2]))
