"""Properties of the evaluation pipeline on the small fixture (sf0.001/0.01)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from perfweave.config import CNN, TARGET_BASE, TARGET_FULL
from perfweave.operators import folds, grid, predict, text
from perfweave.operators.features import engineer
from perfweave.operators.profile import profile
from perfweave.plans import catalog, evaluate, reports
from perfweave.sources.trials import drop_missing_targets, trials


@pytest.fixture(scope="module")
def feats(spark):
    e = evaluate.evaluation_trials(spark, SF01)
    return engineer(e, CNN).cache()


def test_every_row_has_exactly_one_fold(spark):
    t = trials(spark, SF01)
    f = folds.assign_folds(t, catalog.ROW_KEYS, k=5, seed=42)
    counts = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    assert set(counts) == set(range(5))
    assert sum(counts.values()) == t.count()
    assert min(counts.values()) > 0.18 * t.count()


def test_oof_linear_equals_refit_by_filter(spark):
    t = evaluate.with_batch_features(drop_missing_targets(trials(spark, SF001)))
    coef = {r["fold"]: r for r in predict.leave_out_linear(t, "fold", "log2_batch_size", TARGET_FULL, "p").collect()}
    pdf = t.select("fold", "log2_batch_size", TARGET_FULL).toPandas()
    for f, r in coef.items():
        tr = pdf[pdf.fold != f]
        b, a = np.polyfit(tr["log2_batch_size"], tr[TARGET_FULL], 1)
        assert r["p_b"] == pytest.approx(b, rel=1e-9, abs=1e-9)
        assert r["p_a"] == pytest.approx(a, rel=1e-9, abs=1e-9)


def test_oof_group_mean_equals_refit_by_filter(spark):
    t = drop_missing_targets(trials(spark, SF001))
    lo = predict.leave_out_group_mean(t, "fold", TARGET_BASE, ("model",), "p").toPandas()
    pdf = t.select("fold", "model", TARGET_BASE).toPandas()
    for _, r in lo.iterrows():
        tr = pdf[(pdf.fold != r["fold"]) & (pdf.model == r["model"])]
        expect = tr[TARGET_BASE].mean() if len(tr) else pdf[pdf.fold != r["fold"]][TARGET_BASE].mean()
        assert r["p"] == pytest.approx(expect, rel=1e-9)


def test_fold_moments_equal_refit_by_filter(spark):
    t = drop_missing_targets(trials(spark, SF001))
    m = predict.fold_moments(t, "fold", ["T_cpu_io_ms", "batch_size"]).toPandas()
    pdf = t.select("fold", "T_cpu_io_ms", "batch_size").toPandas()
    for _, r in m.iterrows():
        tr = pdf[pdf.fold != r["fold"]]
        assert r["mean__T_cpu_io_ms"] == pytest.approx(tr["T_cpu_io_ms"].mean(), rel=1e-9)
        assert r["std__batch_size"] == pytest.approx(tr["batch_size"].std(ddof=0), rel=1e-9)


def test_feature_invariants(feats):
    r = feats.agg(F.min("mem_headroom").alias("lo"), F.max("mem_headroom").alias("hi"),
                  F.max(F.abs("B_times_arch_Ada")).alias("ada"),
                  F.min(F.col("batch_bin_small") + F.col("batch_bin_medium") + F.col("batch_bin_large")).alias("b0"),
                  F.max(F.col("batch_bin_small") + F.col("batch_bin_medium") + F.col("batch_bin_large")).alias("b1"),
                  F.count_if(F.col("roof_time_ms").isNull()).alias("roof_missing")).first()
    assert 0.0 <= r["lo"] <= r["hi"] <= 1.0
    assert r["ada"] == 0.0          # "Ada" sorts first and is the dropped dummy
    assert r["b0"] == 1 and r["b1"] == 1
    assert r["roof_missing"] == 0   # filled with the median


def test_breakdown_counts_sum_to_gpu_total(spark):
    pred = evaluate.logo_predictions(catalog._eval_trials(spark, SF001))
    b = reports.logo_breakdown(pred).groupBy("breakdown", "gpu_name").agg(F.sum("n_samples").alias("n"))
    s = {r["GPU"]: r["n_samples"] for r in reports.logo_summary(pred).collect()}
    for r in b.collect():
        assert r["n"] == s[r["gpu_name"]]


def test_skew_matches_pandas(spark, feats):
    cols = ["batch_size", "B_times_BW", "mem_pressure", "roof_time_ms"]
    prof = {r["column"]: r for r in profile(feats, cols).collect()}
    pdf = feats.select(*cols).toPandas().astype(float)
    for c in cols:
        assert prof[c]["skew"] == pytest.approx(pdf[c].skew(), rel=1e-6, abs=1e-9)
        assert prof[c]["n_missing"] == int(pdf[c].isna().sum())


def test_vocab_and_encoding_properties(spark):
    corpus = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    toks = text.positioned_tokens(corpus, "doc_id", "text")
    voc = text.build_vocab(toks, max_tokens=500)
    assert voc.count() == 500
    ids = {r["token"]: r["token_id"] for r in voc.collect()}
    assert [ids[s] for s in text.SPECIALS] == [0, 1, 2, 3]
    assert sorted(ids.values()) == list(range(500))
    enc = text.encode_ids(corpus, voc, "doc_id", "text")
    padded, length = text.pad("ids", 16)
    out = enc.select("doc_id", "ids", padded.alias("p"), length.alias("n"),
                     F.size(text.tokenize(F.lit(None))).alias("empty")).collect()
    n_tok = {r["doc_id"]: r["n"] for r in corpus.select("doc_id", F.size(text.tokenize("text")).alias("n")).collect()}
    for r in out:
        assert all(0 <= i < 500 for i in r["ids"])
        assert len(r["p"]) == 16
        assert r["n"] == min(max(n_tok[r["doc_id"]], 1), 16)
        assert r["empty"] == 0


def test_vocab_tie_break_is_first_appearance(spark):
    df = spark.createDataFrame([(1, "b a"), (2, "a b c c")], "doc_id long, text string")
    voc = text.build_vocab(text.positioned_tokens(df, "doc_id", "text"))
    got = {r["token"]: r["token_id"] for r in voc.collect()}
    # a, b, c all appear twice; first appearances: b (1,0) < a (1,1) < c (2,2)
    assert got["b"] == 4 and got["a"] == 5 and got["c"] == 6


def test_encode_keeps_empty_texts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "doc_id long, text string")
    voc = text.build_vocab(text.positioned_tokens(df, "doc_id", "text"))
    out = {r["doc_id"]: r["ids"] for r in text.encode_ids(df, voc, "doc_id", "text").collect()}
    assert out[2] == [0] and out[3] == [0] and len(out[1]) == 2
    wrapped = df.sparkSession.createDataFrame([([5, 6, 7],)], "ids array<int>") \
        .select(text.wrap_truncate("ids", 4).alias("w")).first()["w"]
    assert wrapped == [2, 5, 6, 7]   # <eos> cut by the length limit


def test_grid_sizes_per_host(spark):
    hosts = spark.createDataFrame([("gpu", "NVME", 16)], "gpu_name string, storage string, vcpu_cap bigint")
    assert grid.cnn_grid(hosts).count() == 864
    assert grid.mlp_grid(hosts).count() == 1296
    assert grid.transformer_grid(hosts).count() == 864
    capped = spark.createDataFrame([("gpu", "SSD", 8)], "gpu_name string, storage string, vcpu_cap bigint")
    assert grid.cnn_grid(capped).count() == 864   # workers 4, 8, 8: the clamp drops no row
    assert grid.mlp_grid(capped).count() == 1296


def test_mlp_unknown_model_raises(spark):
    from perfweave.functions.estimators import image_mlp_forward_flops
    df = spark.createDataFrame([("convnet", 32, 8, 3, 128, 8, 128, 512)],
                               "m string, i int, p int, c int, e int, d int, t int, ch int")
    _, fwd = image_mlp_forward_flops("m", "i", "p", "c", "e", "d", "t", "ch")
    with pytest.raises(Exception):
        df.select(fwd).collect()


def test_mlp_flops_closed_form(spark):
    hosts = spark.createDataFrame([("gpu", "NVME", 16)], "gpu_name string, storage string, vcpu_cap bigint")
    g = grid.mlp_grid(hosts).where("model = 'mixer' AND dataset = 'STL10' AND embed_dim = 128").first()
    P, D, depth = (96 // 8) ** 2, 128, 8
    block = 4.0 * D * P * 128 + 4.0 * P * D * 512 + 4.0 * P * D
    assert g["flops_fwd_per_sample"] == pytest.approx(P * 2.0 * 3 * 8 * 8 * D + depth * block)
    assert g["num_patches"] == P and g["depth"] == depth


def test_fold_medians_equal_refit_by_filter(spark):
    rows = [(f, x, y) for f, x, y in [
        ("a", 1.0, None), ("a", 5.0, 2.0), ("b", 2.0, 2.0), ("b", 2.0, 7.0), ("b", 9.0, 1.0),
        ("c", 4.0, 3.0), ("c", None, 3.0), (None, 3.0, 8.0), (None, 7.5, None), ("c", 6.0, None)]]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in predict.fold_medians(df, "g", ["x", "y"]).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    for g in ["a", "b", "c"]:
        tr = pdf[pdf.g != g]   # NULL-fold rows always train
        for c in ["x", "y"]:
            assert got[g][f"med__{c}"] == pytest.approx(tr[c].median())


def test_one_pass_report_equals_row_scoring(spark):
    t = evaluate.with_batch_features(drop_missing_targets(trials(spark, SF001)))
    # missing x on some rows exercises the leave-out-mean fallback
    t = t.withColumn("log2_batch_size", F.when(F.col("l_linenumber") == 2, None)
                     .otherwise(F.col("log2_batch_size")))
    keys = ("model", "vcpu", "storage")
    fast = {tuple(r[k] for k in keys): r for r in reports.kfold_report_from(
        evaluate.linear_report_sums(t, "fold", keys), keys).collect()}
    slow = {tuple(r[k] for k in keys): r for r in reports.kfold_report(
        evaluate.kfold_predictions(t, "fold", "linear"), keys).collect()}
    assert fast.keys() == slow.keys()
    for k, r in slow.items():
        for c in ("n_samples", "RMSE_full_ms", "RMSE_base_ms", "Improvement_pct"):
            assert fast[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9)


def test_one_pass_mean_report_equals_row_scoring(spark):
    t = drop_missing_targets(trials(spark, SF001))
    keys = ("model", "vcpu", "storage")
    fast = {tuple(r[k] for k in keys): r for r in evaluate.kfold_report(spark, SF001, "mean").collect()}
    slow = {tuple(r[k] for k in keys): r for r in reports.kfold_report(
        evaluate.kfold_predictions(t, "fold", "mean"), keys).collect()}
    assert fast.keys() == slow.keys()
    for k, r in slow.items():
        for c in ("n_samples", "RMSE_full_ms", "RMSE_base_ms", "Improvement_pct"):
            assert fast[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9)


def test_reports_do_not_cancel_on_large_values(spark):
    """y near 1e6 with noise near 1e-3: the one-pass RMSE equals per-row scoring to 6 digits."""
    rng = np.random.default_rng(0)
    n = 20000
    b = rng.choice([32, 64, 128, 256], n)
    pdf = pd.DataFrame({"fold": rng.integers(0, 5, n), "model": rng.choice(["a", "b"], n), "vcpu": 4, "storage": "SSD",
                        "batch_size": b, "log2_batch_size": np.log2(b)})
    pdf[TARGET_FULL] = 1e6 + 3 * pdf.log2_batch_size + rng.uniform(-1e-3, 1e-3, n)
    pdf[TARGET_BASE] = pdf[TARGET_FULL] - 1
    t = spark.createDataFrame(pdf)
    keys = ("model", "vcpu", "storage")
    for fast, predictor in ((evaluate.linear_report_sums(t, "fold", keys), "linear"),):
        got = {r["model"]: r for r in reports.kfold_report_from(fast, keys).collect()}
    for m in "ab":
        sq = []
        for f in range(5):
            tr, te = pdf[pdf.fold != f], pdf[(pdf.fold == f) & (pdf.model == m)]
            x, y = tr.log2_batch_size - tr.log2_batch_size.mean(), tr[TARGET_FULL] - tr[TARGET_FULL].mean()
            slope = (x * y).sum() / (x * x).sum()
            sq.append((te[TARGET_FULL] - tr[TARGET_FULL].mean()
                       - slope * (te.log2_batch_size - tr.log2_batch_size.mean())) ** 2)
        assert got[m]["RMSE_full_ms"] == pytest.approx(np.sqrt(pd.concat(sq).mean()), rel=1e-6)


def test_constant_feature_has_no_slope(spark):
    rows = [(i % 3, 0.1, 5.0 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "fold int, x double, y double")
    for r in predict.leave_out_linear(df, "fold", "x", "y").collect():
        assert r["pred_b"] == 0.0 and r["pred_a"] == pytest.approx(np.mean([y for f, _, y in rows if f != r["fold"]]))


def test_exact_medians_equal_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("abc"), 5001), "x": np.round(rng.normal(size=5001), 2)})
    got = {r["g"]: r["median"] for r in predict.exact_medians(spark.createDataFrame(pdf).repartition(7), ["g"]).collect()}
    assert got == pytest.approx(pdf.groupby("g").x.median().to_dict())


def test_infinite_targets_are_kept(spark):
    from perfweave.sources.trials import canonical_trials
    df = spark.createDataFrame([(float("inf"), 1.0, float("nan")), (2.0, float("nan"), 1.0)],
                               f"{TARGET_FULL} double, {TARGET_BASE} double, other double")
    got = [tuple(r) for r in canonical_trials(df).collect()]
    assert got[0] == (float("inf"), 1.0, None) and got[1][0] == 2.0 and np.isnan(got[1][1]) and got[1][2] == 1.0


def test_vocab_cap_keeps_first_seen_ties(spark):
    docs = spark.createDataFrame([(1, "b a c a"), (2, "d e a b f")], "doc_id long, text string")
    toks = text.positioned_tokens(docs, "doc_id", "text")
    got = {r["token"]: r["token_id"] for r in text.build_vocab(toks, max_tokens=8).collect()}
    assert got == {"<unk>": 0, "<pad>": 1, "<bos>": 2, "<eos>": 3, "a": 4, "b": 5, "c": 6, "d": 7}


def test_token_counts_do_not_sort(spark):
    """The first appearance of a token as one number: counted by hash, equal to the least (side, doc, pos)."""
    big = 2 ** 63
    rows = [(big - 1, "c b a"), (None, "z a"), (-big, "y x a"), (-big, "w y"), (3, "c c d"), (3, "d c"), (-3, "q d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toks = text.positioned_tokens(docs, "doc_id", "text").unionByName(text.positioned_tokens(docs, "doc_id", "text", side=1).where("doc_id = 3"))
    counts = text.token_counts(toks)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "HashAggregate" in plan
    want = {}
    for r in toks.collect():
        at = (r["side"], r["doc_id"] is not None, r["doc_id"] or 0, r["pos"])
        n, first = want.get(r["token"], (0, at))
        want[r["token"]] = (n + 1, min(first, at))
    got = {r["token"]: (r["freq"], r["first_seen"]) for r in counts.collect()}
    assert {t: n for t, (n, _) in got.items()} == {t: n for t, (n, _) in want.items()}
    # No two tokens are seen first at the same place but those of equal keys.
    for a in want:
        for b in want:
            assert (got[a][1] < got[b][1]) == (want[a][1] < want[b][1]), (a, b)


def test_placed_sorts_like_its_keys(spark):
    keys = [f"{i * 7919 % 1000:04d}" for i in range(1000)] + ["0003", "0003", None, None, ""]
    rows = text.placed(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int").repartition(5), "k").collect()
    assert sorted(r["i"] for r in rows) == list(range(len(keys)))
    place = {}
    for r in rows:
        assert place.setdefault(r["k"], r["place"]) == r["place"]
    assert sorted(place, key=place.get) == sorted(place, key=lambda k: (k is not None, k or ""))


def test_vocab_of_placed_texts(spark):
    rows = [("b", "x y"), ("a", "y z"), ("a", "w z"), (None, "v u")]
    df = spark.createDataFrame(rows, "id string, t string")
    by_key = text.build_vocab(text.positioned_tokens(df, "id", "t"))
    by_place = text.build_vocab(text.positioned_tokens(text.placed(df, "id"), "place", "t"))
    first = {r["token"]: r["token_id"] for r in by_key.collect()}
    other = {r["token"]: r["token_id"] for r in by_place.collect()}
    tied = {"y", "w"}  # both first at (a, 0)
    assert {t: i for t, i in first.items() if t not in tied} == {t: i for t, i in other.items() if t not in tied}


def test_encoding_tokenises_once(spark):
    df = spark.createDataFrame([(1, "a b", "b"), (2, "", None)], "id long, t string, u string")
    voc = text.build_vocab(text.positioned_tokens(df, "id", "t"))
    enc = text.encode_columns(df, voc, ["id"], {"x": "t", "y": "u"}, keep_tokens=3)
    plan = enc._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # one a text column
    assert {r["id"]: (r["x"], r["y"]) for r in enc.collect()} == {1: ([4, 5], [5]), 2: ([0], [0])}
