"""Leave-out statistics, boosted trees and ridge against refits by filter, in numpy."""

import numpy as np
import pandas as pd
import pytest

from perfweave.operators import gbt, predict, ridge, trees
from perfweave.operators.leaveout import leave_out_moments, leave_out_sums

# ----------------------------------------------------------- leave-out merges


@pytest.fixture(scope="module")
def unlike_folds(spark):
    """Five folds: one with values near 1e9, the others 1 +- 0.001."""
    rng = np.random.default_rng(1)
    rows = [(f, float(x), float(2.0 * x + rng.normal() * 1e-4), "ab"[i % 2])
            for f in range(5) for i, x in enumerate((1e9 if f == 3 else 1.0) + 0.001 * rng.normal(size=40))]
    rows += [(None, 1.0005, 2.001, "a"), (1, None, 2.0, "a"), (2, 1.0, None, "b")]
    return spark.createDataFrame(rows, "fold int, x double, y double, g string").repartition(4).cache(), pd.DataFrame(rows, columns=["fold", "x", "y", "g"])


def test_leave_out_moments_of_unlike_folds(unlike_folds):
    df, pdf = unlike_folds
    got = {r["fold"]: r for r in predict.fold_moments(df, "fold", ["x", "y"]).collect()}
    for f in range(5):
        rest = pdf[pdf.fold != f]
        for c in "xy":
            v = rest[c].dropna().to_numpy()
            assert got[f][f"mean__{c}"] == pytest.approx(v.mean(), rel=1e-12)
            assert got[f][f"std__{c}"] == pytest.approx(v.std(), rel=1e-6)
    assert got[3]["std__x"] < 0.0012


def test_leave_out_regression_and_means_of_unlike_folds(unlike_folds):
    df, pdf = unlike_folds
    lin = {r["fold"]: r for r in predict.leave_out_linear(df, "fold", "x", "y", "p").collect()}
    mean = {(r["fold"], r["g"]): r for r in predict.leave_out_group_mean(df, "fold", "y", ["g"], "p").collect()}
    for f in range(5):
        rest = pdf[pdf.fold != f]
        both = rest.dropna(subset=["x", "y"])
        x, y = both.x.to_numpy(), both.y.to_numpy()
        b = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        assert lin[f]["p_b"] == pytest.approx(b, rel=1e-6)
        assert lin[f]["p_a"] == pytest.approx(y.mean() - b * x.mean(), rel=1e-6, abs=1e-5 if f == 3 else 1.0)
        assert lin[f]["p_train_rows"] == len(both)
        for g in "ab":
            assert mean[f, g]["p"] == pytest.approx(rest[rest.g == g].y.mean(), rel=1e-12)


def test_leave_out_of_one_fold_and_of_none(spark):
    one = spark.createDataFrame([("a", 3.0, 2.0, 0.5)], "f string, n double, m double, q double")
    r = leave_out_moments(one, "f", "n", ["m"], {"q": ("m", "m")}).first()
    assert (r["t_n"], r["t_m"], r["t_q"]) == (0.0, 0.0, 0.0)
    assert leave_out_sums(one, "f", ["n"]).first()["t_n"] == 0.0
    assert leave_out_moments(one.limit(0), "f", "n", ["m"], {}).count() == 0


# -------------------------------------------------------------- boosted trees

def features(n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 1] = np.round(x[:, 1])
    x[:, 2] = rng.integers(0, 2, n)
    x[rng.random(n) < 0.2, 0] = np.nan
    x[:, 4] = np.nan if seed == 0 else x[:, 4]
    y = 3 * np.nan_to_num(x[:, 0], nan=2.0) + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcde"))
    pdf["fold"], pdf["id"], pdf["t1"], pdf["t2"] = rng.integers(0, 3, n), np.arange(n), y, y - x[:, 3]
    return pdf


def frame(spark, pdf, null_fold=()):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False)]
    rows = [(*r[:5], None if r[6] in null_fold else r[5], *r[6:]) for r in rows]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, e double, fold int, id long, t1 double, t2 double").repartition(5)


def plain_tree(x, g, depth, l2, step, cuts):
    """Greedy tree on raw values: split (feature, cut, missing side) of largest gain, recursively."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            gone = np.isnan(x[:, j])
            for cut in cuts[j]:
                for missing_left in (False, True):
                    left = np.where(gone, missing_left, x[:, j] <= cut)
                    n, m = left.sum(), (~left).sum()
                    if n < 1 or m < 1:
                        continue
                    gain = g[left].sum() ** 2 / (n + l2) + g[~left].sum() ** 2 / (m + l2) - g.sum() ** 2 / (len(g) + l2)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, j, cut, missing_left, left
    if best is None:
        return step * g.sum() / (len(g) + l2)
    _, j, cut, missing_left, left = best
    return j, cut, missing_left, *(plain_tree(x[s], g[s], depth - 1, l2, step, cuts) for s in (left, ~left))


def plain_predict(tree, row):
    while isinstance(tree, tuple):
        j, cut, missing_left, a, b = tree
        tree = a if (missing_left if np.isnan(row[j]) else row[j] <= cut) else b
    return tree


SMALL = dict(max_iter=3, max_depth=3, step_size=0.3, subsampling_rate=1.0, feature_subset="1.0", l2=1.2)


def test_three_trees_equal_a_refit_by_filter(spark):
    pdf = features()
    df = frame(spark, pdf, null_fold=(5, 6))
    pdf.loc[[5, 6], "fold"] = -1
    got = {r["id"]: r for r in gbt.oof_gbt(df, "fold", [("p1", "t1", list("abcd")), ("p2", "t2", list("abd"))], ["id"], params=SMALL).collect()}
    assert set(got) == set(pdf.id[pdf.fold >= 0])
    cuts = dict(zip("abcde", gbt.bin_cuts(df, list("abcde"))))
    for f in range(3):
        rest, test = pdf[pdf.fold != f], pdf[pdf.fold == f]
        for name, target, feats in (("p1", "t1", list("abcd")), ("p2", "t2", list("abd"))):
            x, y = rest[feats].to_numpy(), rest[target].to_numpy()
            margin, fits = np.full(len(y), y.mean()), []
            for _ in range(3):
                fits.append(plain_tree(x, y - margin, 3, 1.2, 0.3, [cuts[c] for c in feats]))
                margin = margin + [plain_predict(fits[-1], r) for r in x]
            for r in test.itertuples():
                want = y.mean() + sum(plain_predict(t, np.array([getattr(r, c) for c in feats])) for t in fits)
                assert got[r.id][name] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("impute", [False, True])
def test_large_models_grow_like_small_ones(spark, monkeypatch, impute):
    """Levels by histogram aggregates, subtrees finished in tasks, predictions rewritten: the trees are the same."""
    monkeypatch.setattr(gbt, "KEEP", 2)
    df = frame(spark, features())
    args = (df, "fold", [("p1", "t1", list("abcde")), ("p2", "t2", list("acd"))], ["id"])
    params = {**SMALL, "max_iter": 3, "max_depth": 5, "subsampling_rate": 0.8, "feature_subset": "0.7"}
    a, b = ({r["id"]: (r["p1"], r["p2"]) for r in gbt.oof_gbt(*args, params=params, impute=impute, local_rows=n).collect()} for n in (10**6, 60))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def test_boosting_imputes_with_training_medians(spark):
    pdf = features()
    whole = pdf.copy()
    df = frame(spark, pdf)
    got = {r["id"]: r["p"] for r in gbt.oof_gbt(df, "fold", [("p", "t1", list("abcd"))], ["id"], folds=[1], params=SMALL, impute=True).collect()}
    whole["a"] = whole["a"].fillna(pdf[pdf.fold != 1]["a"].median())
    cuts = gbt.bin_cuts(df, list("abcd"))
    rest, test = whole[whole.fold != 1], whole[whole.fold == 1]
    # In bins, like the operator: the median falls in the bin of the first cut that is not below it.
    binned = lambda d: np.column_stack([np.array(c)[gbt.bin_of(d[k].to_numpy(), np.array(c))] for k, c in zip("abcd", cuts)])
    x, y = binned(rest), rest.t1.to_numpy()
    margin, fits = np.full(len(y), y.mean()), []
    for _ in range(3):
        fits.append(plain_tree(x, y - margin, 3, 1.2, 0.3, cuts))
        margin = margin + [plain_predict(fits[-1], r) for r in x]
    for i, r in zip(test.id, binned(test)):
        assert got[i] == pytest.approx(y.mean() + sum(plain_predict(t, r) for t in fits), rel=1e-9)


def test_boosting_odd_inputs(spark):
    pdf = features(60, seed=0)  # feature e has no value
    df = frame(spark, pdf)
    out = gbt.oof_gbt(df, "fold", [("p", "t1", list("abe"))], ["id"], params=SMALL)
    assert out.columns == ["id", "fold", "t1", "p"] and out.where("p IS NULL").count() == 0
    assert gbt.oof_gbt(df.limit(0), "fold", [("p", "t1", list("ab"))], ["id"], params=SMALL).count() == 0
    assert gbt.oof_gbt(df, "fold", [("p", "t1", list("ab"))], ["id"], folds=[99], params=SMALL).count() == 0
    one = df.where("fold = 0")  # no training row for the only fold
    assert one.count() and gbt.oof_gbt(one, "fold", [("p", "t1", list("ab"))], ["id"], params=SMALL).where("p <> 0").count() == 0


def test_trees_pack_and_graft():
    t = trees.Tree()
    left = t.split(0, 2, 5, True)
    sub = trees.Tree()
    sub.split(0, 1, 3, False)
    sub.value[1:] = [7.0, 8.0]
    t.graft(left + 1, sub)
    u = trees.Tree.unpack(t.pack())
    assert u.pack() == t.pack() and u.feature == [2, -1, 1, -1, -1] and u.value[3:] == [7.0, 8.0]


def test_samples_do_not_depend_on_order():
    p = trees.Params(10, 0.1, 3, 0.5, 0.5, 1.0)
    ids = np.arange(-500, 500)
    a = trees.sampled(ids, 3, p)
    assert (trees.sampled(ids[::-1], 3, p) == a[::-1]).all() and 400 < a.sum() < 600
    assert (trees.sampled(ids, 4, p) != a).any() and len(trees.columns(9, 1, p)) == 4


# ----------------------------------------------------------------------- ridge

def plain_ridge(train, test, feats, target, lam):
    med = train[feats].median().fillna(0.0)
    x, y = train[feats].fillna(med).to_numpy(), train[target].to_numpy()
    mu, sd = x.mean(0), x.std(0)
    sd[sd < 1e-12] = np.inf
    z = (x - mu) / sd
    beta = np.linalg.solve(z.T @ z / len(z) + lam * np.eye(len(feats)), z.T @ (y - y.mean()) / len(z))
    return y.mean() + ((test[feats].fillna(med).to_numpy() - mu) / sd) @ beta


@pytest.mark.parametrize("block", [64, 3])
def test_ridge_equals_refit_by_filter(spark, block):
    pdf = features()
    pdf["e"] = 5.0  # constant
    pdf.loc[pdf.index % 9 == 0, "b"] = np.nan
    df = frame(spark, pdf, null_fold=(5, 6))
    pdf.loc[[5, 6], "fold"] = -1
    got = {r["id"]: r for r in ridge.oof_ridge(df, "fold", [("p1", list("abcde"), "t1"), ("p2", list("bd"), "t2")], ["id"], lam=0.5, block=block).collect()}
    assert set(got) == set(pdf.id[pdf.fold >= 0])
    for f in range(3):
        train, test = pdf[pdf.fold != f], pdf[pdf.fold == f]
        for name, feats, target in (("p1", list("abcde"), "t1"), ("p2", list("bd"), "t2")):
            assert np.allclose([got[i][name] for i in test.id], plain_ridge(train, test, feats, target, 0.5), rtol=1e-8, atol=1e-8)


def test_ridge_of_unlike_folds(spark):
    """A fold a billion times larger does not spoil the model of the others."""
    pdf = features()
    pdf["d"] = 1.0 + 0.001 * pdf["d"]
    pdf.loc[pdf.fold == 2, "d"] *= 1e9
    pdf["t1"] = pdf["t1"] + 1000 * pdf["d"]
    got = {r["id"]: r["p"] for r in ridge.oof_ridge(frame(spark, pdf), "fold", [("p", list("abcd"), "t1")], ["id"]).collect()}
    train, test = pdf[pdf.fold != 2], pdf[pdf.fold == 2]
    assert np.allclose([got[i] for i in test.id], plain_ridge(train, test, list("abcd"), "t1", 1.0), rtol=1e-6)


def test_ridge_small_folds_only_train(spark):
    pdf = features(200)
    pdf.loc[pdf.index < 2, "fold"] = 7
    pdf.loc[pdf.index >= 2, "fold"] %= 3
    got = ridge.oof_ridge(frame(spark, pdf), "fold", [("p", list("ab"), "t1")], ["id"], min_rows=3).collect()
    assert {r["fold"] for r in got} == {0, 1, 2}


# -------------------------------------------------------- train-only statistics

def test_third_moments_merge_like_refits(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"fold": rng.integers(0, 4, 300), "x": rng.gamma(1.5, size=300) * np.where(rng.random(300) < 0.1, 1e6, 1.0)})
    rows = []
    for f, g in pdf.groupby("fold"):
        d = g.x - g.x.mean()
        rows.append((int(f), float(len(g)), float(g.x.mean()), float((d ** 2).sum()), float((d ** 3).sum())))
    table = spark.createDataFrame(rows, "f int, n double, m double, q double, t double")
    for r in leave_out_moments(table, "f", "n", ["m"], {"q": ("m", "m")}, cubes={"t": ("m", "q")}).collect():
        x = pdf[pdf.fold != r["f"]].x
        d = x - x.mean()
        assert (r["t_n"], r["t_m"], r["t_q"], r["t_t"]) == pytest.approx((len(x), x.mean(), (d ** 2).sum(), (d ** 3).sum()), rel=1e-9)


def test_train_only_features(spark):
    """A category, a heavy tail and a median that only one fold has make no column and no fill for that fold."""
    from perfweave.config import CNN, TARGET_FULL
    from perfweave.operators.train_features import train_features

    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        fold = i % 3
        gpu = ["NVIDIA L4", "Tesla T4", "NVIDIA H100 PCIe" if fold == 2 else "Tesla T4"][i % 5 % 3]
        storage = "TAPE" if fold == 1 and i % 2 else ["NVME", "SSD"][i // 3 % 2]
        bw = {"NVIDIA L4": 300.0, "Tesla T4": 320.0}.get(gpu)
        rows.append((i, fold, gpu, storage, 32 * (1 + i % 4), bw, 40.0 if i % 7 else None, 30.0, 60.0, 24.0, 1e9 * (1 + i % 5),
                     float(1e4 if fold == 0 and i % 30 == 0 else 1.0 + rng.random()), 1.0 + i, 2.0 + i))
    cols = "id long, fold int, gpu_name string, storage string, batch_size long, bw_gbs double, SM double, FP32 double, FP16 double, mem_gb double, " \
           "flops_train_per_batch double, oddity double, avg_batch_time_ms double, T_gpu_ms double"
    e = spark.createDataFrame(rows, cols)
    f = train_features(e, CNN, TARGET_FULL, "fold", ["id"])
    got = {r["id"]: r for r in f.collect()}
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in cols.split(", ")])
    assert len(got) == 120
    for r in pdf.itertuples():
        g, rest = got[r.id], pdf[pdf.fold != r.fold]
        cats = sorted(rest.storage.unique())
        for v in ("NVME", "SSD", "TAPE"):
            if f"storage_{v}" in g:
                assert g[f"storage_{v}"] == (int(r.storage == v) if v in cats[1:] else None)
        fill = rest.bw_gbs.median()
        assert g["B_times_BW"] == pytest.approx(r.batch_size * (r.bw_gbs if not np.isnan(r.bw_gbs) else fill))
        for c in ("oddity", "B_times_BW", "B_times_SM", "roof_time_ms", "flops_train_per_batch"):
            x = pd.Series([_trained(q, c, rest) for q in rest.itertuples()], dtype=float)
            take = x.skew() > 1.0 and not (x < 0).any() and not x.isin([0, 1]).all()
            want = np.log1p(g[c]) if take else None
            have = g[f"log1p__{c}"] if f"log1p__{c}" in g else None
            assert (have is None and want is None) or have == pytest.approx(want)
    assert got[1]["log1p__oddity"] is not None and got[0]["log1p__oddity"] is None


def _trained(q, c, rest):
    """Feature value of a training row under the medians of ``rest``."""
    if c == "B_times_BW":
        return q.batch_size * (q.bw_gbs if not np.isnan(q.bw_gbs) else rest.bw_gbs.median())
    if c == "B_times_SM":
        return q.batch_size * (q.SM if not np.isnan(q.SM) else rest.SM.median())
    if c == "roof_time_ms":
        return q.flops_train_per_batch / 30.0 * 1000.0  # no AMP column and no activation bytes: compute time is the roof
    return getattr(q, c)


def test_column_moments_and_medians_in_batches(spark):
    """Statistics of many columns without unpivoting: constants, nulls, folds apart, narrow and wide value ranges."""
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n), "same": 0.1, "wide": np.exp(rng.normal(0, 9, n)) * rng.choice([-1, 1], n),
                        "narrow": 1.0 + rng.random(n) * 1e-6, "big": 1e9 + rng.random(n), "none": np.nan})
    pdf.loc[::7, "wide"] = np.nan
    cols = ["same", "wide", "narrow", "big", "none"]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    med = {r["g"]: r for r in predict.fold_medians(df, "g", cols).collect()}
    mom = {r["g"]: r for r in predict.fold_moments(df, "g", cols).collect()}
    for g in "abc":
        rest = pdf[pdf["g"] != g]
        for c in cols[:4]:
            assert med[g][f"med__{c}"] == pytest.approx(rest[c].median(), rel=1e-15)
            assert mom[g][f"mean__{c}"] == pytest.approx(rest[c].mean(), rel=1e-12)
            sd = rest[c].std(ddof=0) if c != "same" else 1.0  # no spread: 1, not a rounding error
            assert mom[g][f"std__{c}"] == pytest.approx(sd, rel=1e-6)
        assert med[g]["med__none"] is None and mom[g]["mean__none"] is None


def test_narrow_ranges_are_cut_again(spark, monkeypatch):
    """A value range with very many rows is cut into narrower ones before its values are counted."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 3000), "x": 5.0 + rng.random(3000) * 1e-3, "y": rng.integers(-3, 4, 3000) * 1.0})
    steps = []
    counts = predict.range_counts
    monkeypatch.setattr(predict, "MANY", 100)
    monkeypatch.setattr(predict, "range_counts", lambda rows, p, bits, *a: steps.append(bits) or counts(rows, p, bits, *a))
    got = {r["g"]: r for r in predict.fold_medians(spark.createDataFrame(pdf).repartition(3), "g", ["x", "y"]).collect()}
    assert steps == [18, 40, 64]
    for g in range(4):
        rest = pdf[pdf["g"] != g]
        assert (got[g]["med__x"], got[g]["med__y"]) == (rest["x"].median(), rest["y"].median())


def test_ranges_of_one_value_need_no_further_pass(spark, monkeypatch):
    """Flags and few kinds of values end with the first pass; the next ones read only columns with more."""
    rng = np.random.default_rng(7)
    n = 2000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n), "flag": rng.integers(0, 2, n) * 1.0, "size": rng.choice([32.0, 64.0, 128.0], n),
                        "neg": rng.choice([-0.0, 0.0, -2.5], n), "wide": 5.0 + rng.random(n) * 1e-3})
    pdf.loc[::9, "size"] = np.nan
    steps = []
    counts = predict.range_counts
    monkeypatch.setattr(predict, "range_counts", lambda rows, p, bits, above, opened, *a: steps.append((bits, opened and set(opened)))
                        or counts(rows, p, bits, above, opened, *a))
    cols = ["flag", "size", "neg", "wide"]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    few = {r["g"]: r for r in predict.fold_medians(df, "g", cols[:3]).collect()}
    assert steps == [(18, None)]
    steps.clear()
    every = {r["g"]: r for r in predict.fold_medians(df, "g", cols).collect()}
    assert steps == [(18, None), (64, {3})]
    for g in "abc":
        rest = pdf[pdf["g"] != g]
        assert [few[g][f"med__{c}"] for c in cols[:3]] == [rest[c].median() for c in cols[:3]]
        assert [every[g][f"med__{c}"] for c in cols] == [rest[c].median() for c in cols]


def test_ridge_scores_rows_of_folds_with_a_model(spark):
    """Missing features take the fill; folds without a model go; a model without training rows predicts nothing."""
    from perfweave.operators.ridge import scored
    nan = float("nan")
    table = spark.createDataFrame([(1, "a", [1.0, nan]), (2, "b", [2.0, 3.0]), (3, None, [0.0, 0.0]), (4, "c", [1.0, 1.0])],
                                  "id int, __fold string, __x array<double>")
    fitted = spark.createDataFrame([("a", [0.0, 4.0], 1.0, [2.0, 0.5]), ("b", [0.0, 0.0], None, [0.0, 0.0])],
                                   "fold string, fill array<double>, p_a double, p_b array<double>")
    got = sorted((r["id"], r["p"]) for r in scored(table, fitted, ["id", "__fold", "__x"], ["p"]).collect())
    assert got == [(1, 5.0), (2, None)]


def test_wide_projections_use_methods_the_jvm_compiles(spark):
    from perfweave.session import jit_sized_methods
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        jit_sized_methods(spark)
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, "50000")  # a setting of the session stays
        jit_sized_methods(spark)
        assert spark.conf.get(name) == "50000"
    finally:
        spark.conf.set(name, before)
