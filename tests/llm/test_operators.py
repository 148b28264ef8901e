"""Training-data operators against plain definitions, on small tables with every odd case."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from perfweave.llm import (components, jaccard_adaptive, langid_gru, mixing, packing_bestfit, preference, quality_risk,
                           secrets_markov, substring_cover, topk_pivots, toxicity_fm, wordhash)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, block int, id long, t string"


def corpus(n=60, seed=3):
    """Texts with copies, near copies, shared passages, odd spacing and empty texts."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["Été", "naïve", "x²", "DE-F", "a,b"]
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 19, 49, 50, 51, 120, 400]))]
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(10):]
        if i % 5 == 4 and texts:
            w = texts[rng.randrange(len(texts))].split()
            if i % 2 and w:
                w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w) if i % 3 else "\n".join(" ".join(w[k:k + 9]) for k in range(0, len(w), 9)))
    texts += ["", None, "   \t\n", "one", " lead  and trail ", "a\x0bb\x0cc\rd", "same line\nsame line\nsame line\n" * 9,
              "x" * 30000, "r s t u v w x y " * 300]
    return texts


def frame(spark, texts, extra=()):
    rows = [(i, t, "en" if i % 3 else "fr", "src%d" % (i % 2), 7, 8, 9, 10, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), DOCS)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring_removal(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_cover.digest(docs).collect()}
    assert got == brute.substring(list(enumerate(texts)))
    kept = {r.doc_id: r.kept for r in substring_cover.repeated(docs).collect()}
    assert all(hashlib.sha256(kept[i].encode()).hexdigest() == got[i][2] for i in got)


def test_substring_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, long), (None, long), (5, long), (5, long), (7, "p q " + long)],
                                 "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substring_cover.repeated(rows).collect())
    assert got == [(False, 5, 0), (False, 5, 0), (False, 7, 60), (True, 0, 60), (True, 0, 60)]


def test_cover_gives_every_pair_an_aligned_anchor():
    c = set(substring_cover.COVER)
    for i in range(substring_cover.PERIOD):
        for j in range(substring_cover.PERIOD):
            assert any((i + d) % substring_cover.PERIOD in c and (j + d) % substring_cover.PERIOD in c
                       for d in range(substring_cover.PERIOD))


def test_quality_figures(spark, docs, texts):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality_risk.verdicts(docs, labels).collect()}
    assert got == {i: brute.quality(t) for i, t in enumerate(texts)}


def _tail(n, k, p):
    from math import comb
    return sum(comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 5, 30, 200, 900) for k in range(0, n + 1, max(1, n // 17))]
    rows = spark.createDataFrame(cases, "n long, k long")
    for r in rows.select("n", "k", quality_risk.binomial_tail(F.col("n"), F.col("k"), 0.03).alias("p")).collect():
        exact = _tail(r.n, r.k, 0.03)
        assert r.p == 1.0 if r.k >= r.n * 0.03 else abs(r.p - exact) < 1e-9 + 1e-6 * exact


def test_quality_cutoffs_follow_the_bound(spark):
    """4,000 good documents with 1 % symbols at most, 400 bad ones full of symbols."""
    good = [(i, " ".join(f"word{(i * 7 + j) % 997}" for j in range(40)), "en") for i in range(4000)]
    bad = [(10000 + i, " ".join(f"wo#${j}%%#{i}" for j in range(40)), "en") for i in range(400)]
    rare = [(20000 + i, " ".join(f"q{j}#" for j in range(40)), "xx") for i in range(10)]
    docs = spark.createDataFrame(good + bad + rare, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad] + [(i, 1) for i, _, _ in rare],
                                   "doc_id long, quality int")
    kept = {r.doc_id for r in quality_risk.verdicts(docs, labels).where("kept").collect()}
    assert sum(i in kept for i, _, _ in good) >= 0.98 * 4000
    assert not any(i in kept for i, _, _ in bad)
    assert all(i in kept for i, _, _ in rare)  # too few labels for a cutoff
    assert {r.doc_id for r in quality_risk.filter_documents(docs, labels).collect()} == kept


def test_quality_keeps_columns_and_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality_risk.filter_documents(docs.withColumn("_stratum", F.lit(1)), labels)
    assert out.columns == [*docs.columns, "_stratum"]
    rows = spark.createDataFrame([(None, "a b c " * 2, None), (None, " ".join(map(str, range(30))), None),
                                  (4, " ".join(map(str, range(30))), "en"), (4, "x", "en")],
                                 "doc_id long, text string, lang string")
    got = sorted((r.doc_id is None, len(r.text)) for r in quality_risk.filter_documents(rows, labels).collect())
    n = len(" ".join(map(str, range(30))))
    assert got == [(False, n), (True, n)]


def test_jaccard_components(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_adaptive.near_duplicates(docs).collect()}
    assert got == brute.jaccard(list(enumerate(texts)))


def test_jaccard_large_near_copy_groups(spark):
    """Chains and stars of near copies, where copies link only through others."""
    rng = random.Random(5)
    rows, base = [], [f"b{i}" for i in range(300)]
    for i in range(120):  # each with its own edits: some pairs below the limit
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            w[rng.randrange(300)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((1000 - i, " ".join(w)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(30):  # a sliding window: only neighbours link
        rows.append((2000 + i, " ".join(chain + [f"d{j}" for j in range(4 * i, 4 * i + 40)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.jaccard(rows)
    for salt in (jaccard_adaptive.SALT_ROWS, 10):
        old, jaccard_adaptive.SALT_ROWS = jaccard_adaptive.SALT_ROWS, salt
        try:
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_adaptive.near_duplicates(docs).collect()}
        finally:
            jaccard_adaptive.SALT_ROWS = old
        assert got == want


def test_jaccard_removal_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(3, t, "x"), (2, t, "y"), (None, t, "z"), (9, "", "e"), (8, None, "n"), (3, t, "x")],
                                 "doc_id long, text string, component_id string")
    kept = jaccard_adaptive.one_of_each(rows)
    assert sorted(r.component_id for r in kept.collect()) == ["e", "n", "y", "z"]
    got = {(r.doc_id, r.component_id) for r in jaccard_adaptive.near_duplicates(rows).collect()}
    assert got == {(3, 2), (2, 2), (None, 2), (9, 9), (8, 8)}


def test_prefixes_hold_the_common_shingles():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        f = np.sort(rng.integers(1, 50, n))
        l, length = jaccard_adaptive.choose_matches(f, n, 90)
        common = jaccard_adaptive.least_common(n, 90)
        assert 1 <= l <= common and length == n - common + l <= n


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (50, 1000)]
    random.Random(2).shuffle(links)
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 7: 3, 9: 3, 50: 50, 1000: 50}


def test_secret_spans(spark, docs):
    odd = ["password = abcdefghijklmnop", "token: token:abcdefghijklmnopq", "SECRET='a.b-c_d/e+f=g12345' tail",
           "AKIAABCDEFGHIJKLMN AKIAAKIAAKIA", "é" * 5 + "0123456789abcdef0 deadbeef", "api_key==xxxxxxxxxxxxxxxx",
           "apikey:short token=secret=abcdefghijklmnop", "tökenpasswd:\"0123456789abcdef0123\"", None, ""]
    rows = [(i, t) for i, t in enumerate(odd)]
    for r in secrets_markov.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = brute.secrets(odd[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), odd[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex")]


def test_markov_spans_and_masking(spark):
    rng = random.Random(1)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    samples = [("".join(rng.choice(chars) for _ in range(30)), 1) for _ in range(300)]
    samples += [("_".join(rng.choice(["get", "value", "index", "buffer", "count", "of", "max"]) for _ in range(5)), 0)
                for _ in range(300)]
    model = secrets_markov.train(spark.createDataFrame(samples + [(None, 1), ("a", None)], "text string, label int"))
    key = "".join(rng.choice(chars) for _ in range(32))
    text = f"call get_value_of_buffer_index with {key} and token=abcdefabcdef1234 end"
    docs = spark.createDataFrame([(1, text, "c"), (2, None, "c"), (3, "plain", "c")], "doc_id long, text string, _base string")
    out = {r.doc_id: r for r in secrets_markov.redact(docs, model).collect()}
    assert out[1].text == "call get_value_of_buffer_index with [SECRET] and [SECRET] end"
    assert out[2].text is None and out[3].text == "plain" and out[1]._base == "c"


def test_packing(spark, docs, texts):
    packed = packing_bestfit.pack(docs, with_ids=True)
    rows = packed.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute.pieces(enumerate(texts))
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    joined = {r.sequence_id: bytes(r.ids) for r in packing_bestfit.sequences(packed).collect()}
    assert all(len(joined[s]) == 4 * sum(n for _, n in p) for s, p in seqs.items())


def test_packing_word_memo_matches_the_tokenizer(texts):
    code = packing_bestfit.Coder(packing_bestfit.tokenizer_path())
    odd = ["a  b", " a", "a ", "a\n b", "a\n\n b  c", "<|endoftext|> x", "é à\tü x²", "I'm we'll 'S 12,5 €5", "中文 字"]
    for t in [*texts, *odd]:
        assert list(np.frombuffer(code.ids(t or ""), "<u4")) == brute.tokens(t)[:-1]


def _decreasing_best_fit(sizes, capacity):
    gaps = []
    for n in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_sweeps_are_best_fit_decreasing():
    rng = random.Random(4)
    for capacity in (10, 64, 1024):
        for _ in range(20):
            sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
            counts = {n: sizes.count(n) for n in set(sizes)}
            plan = packing_bestfit.sweep(counts, capacity)
            used = {}
            for length, lo, hi, per, seq, at in plan:
                for i in range(hi - lo):
                    used.setdefault(seq + i // per, []).append((at + i % per * length, length))
            for parts in used.values():
                end = 0
                for o, n in sorted(parts):
                    assert o == end
                    end += n
                assert end <= capacity
            assert sum(map(len, used.values())) == len(sizes)
            assert len(used) == _decreasing_best_fit(sizes, capacity)


def test_language_network_gradients():
    net = langid_gru.Network(["a", "b"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, w = np.array([[1, 2, 3, 1], [4, 2, 2, 5]], np.uint8), np.array([0, 1]), np.array([1.0, 2.0])
    _, g = net.gradients(x, y, w)
    for name, cell in (("E0", (2, 4)), ("E1", (3, 7)), ("U0", (1, 2)), ("U1", (0, 8)), ("O0", (1, 1)), ("b", (0,))):
        old = net.p[name][cell]
        net.p[name][cell] = old + 1e-4
        up, _ = net.gradients(x, y, w)
        net.p[name][cell] = old - 1e-4
        down, _ = net.gradients(x, y, w)
        net.p[name][cell] = old
        assert abs((up - down) / 2e-4 - g[name][cell]) < 1e-5


def test_language_prediction(spark, empty):
    rng = random.Random(0)
    kind = {"x": ["thing", "the", "ther", "and"], "y": ["ção", "não", "uma", "coisa"]}
    rows = [(i, " ".join(rng.choice(kind[k]) for _ in range(12)), k) for i in range(200) for k in ["xy"[i % 2]]]
    rows += [(900, None, "x"), (901, "12 ² --", "x"), (902, "", None), (903, "the thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid_gru.digest(docs).collect()}
    assert all(got[i].lang_pred == k for i, t, k in rows[:200])
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "x"]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid_gru.digest(empty).collect() == []


def test_toxicity(spark, empty):
    rng = random.Random(0)
    plain = [f"n{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(plain) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            w[3], w[40] = "rude", "nasty"
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad), 1))
    rows += [(5000, None), (5001, "")]
    labels += [(None, 1, 1), (3, None, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity_fm.digest(docs, known).collect()}
    assert len(got) == 702
    wrong = sum(got[i].predicted != int(i % 5 == 0) for i in range(700))
    assert wrong <= 7
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert got[5000].score == got[5001].score
    none = toxicity_fm.digest(docs, known.limit(0)).collect()
    assert all(r.score == 0 for r in none)
    assert toxicity_fm.digest(empty, known).collect() == []


def test_toxicity_learns_a_pair_no_single_weight_can():
    """Two terms that are harmless alone and toxic together."""
    rng = np.random.default_rng(0)
    samples = []
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        samples.append((np.unique(np.concatenate([rng.integers(100, 400, 5), [1] * int(a), [2] * int(b)])).astype(np.int32), int(a and b)))
    m = toxicity_fm.train(samples)
    rows = m.rows()
    p = [float(toxicity_fm.probability(m.bias, rows[np.array(s)].sum(0, keepdims=True))[0]) for s in ([1], [2], [1, 2])]
    assert p[0] < 0.5 and p[1] < 0.5 and p[2] > 0.5


def _vectors(rng, n, width):
    return {i: [float(x) for x in rng.normal(0, 0.2, width)] for i in range(n)}


def _floor(v):
    return [int(np.floor(1024.0 * x)) for x in v]


def test_topk_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = _vectors(rng, 400, 9)
    for i in range(100, 140):
        rows[i] = rows[100]  # many equal vectors, a query among them
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = topk_pivots.top_k(table, pivots=6, sample=64, block=50, chunk=2)
    assert sorted(map(tuple, got.collect())) == brute.top_products({i: _floor(v) for i, v in rows.items()})


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (5, [0.5, -0.25]), (5, [0.5, -0.25]), (6, []), (100, [0.1, 0.1]), (7, [3.0])]
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, d string")
    want = brute.top_products({i: _floor(np.float32(v).astype(float)) + [0] * (2 - len(v)) for i, v in (
        (0, [1.0, 2.0]), (5, [0.5, -0.25]), (6, []), (100, [0.1, 0.1]), (7, [3.0]))})
    assert sorted(map(tuple, topk_pivots.top_k(table).collect())) == want
    assert topk_pivots.top_k(table.limit(0)).collect() == []


def test_word_hashes():
    a, starts, ends = wordhash.word_hashes(" ab  c\x0bab\n".encode())
    assert list(zip(starts, ends)) == [(1, 3), (5, 6), (7, 9)] and a[0] == a[2] != a[1]
    b, _, _ = wordhash.word_hashes("c ab c ab".encode())
    assert b[0] == a[1] and b[1] == a[0]
    w = wordhash.window_hashes(b, 2)
    assert w[0] == w[2] != w[1] and len(wordhash.window_hashes(b, 5)) == 0
    one = wordhash.window_hashes(b, 2, np.array([2]))
    assert one[0] == w[0]


def test_mixing_budgets(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 2 else "fr", f"s{i % 5}") for i in range(600)]
    rows += [(None, "a b", None, None), (None, "a b", None, None), (7000, None, "en", "s1"), (7001, "", "de", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, alloc string")
    all_tokens = sum(len(brute.words(t)) for _, t, _, _ in rows)
    for share in (0.3, 0.9, 2.5):
        got = mixing.selection(docs, budget_share=share, max_epochs=3).collect()
        used = sum(r.n_tokens for r in got)
        leaves = len({(r[2], r[3]) for r in rows})
        assert int(all_tokens * share) - 8 * leaves <= used <= int(all_tokens * share)
        assert max(r.epoch for r in got) <= 2
    plan = mixing.select_documents(docs, budget_share=1.0)
    assert plan.columns == docs.columns
    assert mixing.selection(docs.limit(0)).collect() == []


def test_mixing_shortage_goes_to_siblings_first(spark):
    """A short source's tokens go to the other source of its language, not to the other language."""
    rows = [(i, "w", "en", "src1") for i in range(4)] + [(100 + i, "w", "en", "src2") for i in range(400)]
    rows += [(1000 + i, "w", "es", "src2") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = mixing.domain_of  # both sources in one domain for this test
    mixing_domain = lambda c: F.lit("domain0")
    try:
        mixing.with_leaf.__defaults__ = (mixing_domain,)
        got = mixing.selection(docs, budget_share=0.25, max_epochs=1).groupBy("lang", "source").agg(F.sum("n_tokens")).collect()
    finally:
        mixing.with_leaf.__defaults__ = (one,)
    n = {(r[0], r[1]): r[2] for r in got}
    total = int(804 * 0.25)
    assert n[("en", "src1")] == 4
    assert n[("en", "src2")] == int(total * 4 / 7 - 4 + 1e-9) and n[("es", "src2")] == int(total * 3 / 7)


def test_preference_segments(spark):
    c = [(1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "good"), (1, "chosen", 2, "user", "thanks"),
         (1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "bad"),
         (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"),
         (3, "chosen", 0, "user", None), (3, "chosen", 2, "assistant", "late"), (3, "rejected", 0, "user", ""),
         (3, "rejected", 2, "assistant", "late"), (4, "chosen", 0, "user", "alone"),
         (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x"), (1, "chosen", 0, "user", "q")]
    turns = spark.createDataFrame([(*r, "e") for r in c], "pair_id long, side string, turn long, role string, text string, seq string")
    got = sorted((r.pair_id, r.part, r.seq, r.segment, r.trained) for r in preference.segments(turns).collect())
    assert got == sorted([
        (1, "prompt", 0, "<|user|>\nq\n", False), (1, "chosen", 0, "<|assistant|>\ngood\n", True),
        (1, "chosen", 1, "<|user|>\nthanks\n", False), (1, "rejected", 0, "<|assistant|>\nbad\n", True),
        (2, "prompt", 0, "<|user|>\nsame\n", False), (3, "prompt", 0, "<|user|>\n\n", False),
        (3, "chosen", 0, "<|assistant|>\nlate\n", True), (3, "rejected", 0, "<|assistant|>\nlate\n", True),
        (4, "chosen", 0, "<|user|>\nalone\n", False)])
    whole = {r.pair_id: r for r in preference.assemble(preference.segments(turns)).collect()}
    assert whole[1].prompt == "<|user|>\nq\n" and whole[1].chosen_trained == "0:19" and whole[1].rejected_trained == "0:18"
    assert preference.segments(turns.limit(0)).collect() == []


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substring_cover.digest(empty).collect() == []
    assert quality_risk.verdicts(empty, labels).collect() == []
    assert quality_risk.filter_documents(empty, labels).columns == empty.columns
    assert jaccard_adaptive.near_duplicates(empty).collect() == []
    assert jaccard_adaptive.one_of_each(empty).collect() == []
    assert secrets_markov.digest(empty).collect() == []
    assert packing_bestfit.pack(empty).collect() == []
    assert mixing.select_documents(empty).collect() == []


def test_top_products_of_large_components_are_exact(spark):
    """Scores beyond 2**53 are whole numbers, beyond a long the nearest long; squares need not be finite."""
    import math
    rows = [(0, [2e5, 3e5, 1.0]), (1, [1e5 + 0.123, 2e5, 0.5]), (2, [1e17, 0.0]), (3, [1e17, 1.0, 1.0]), (4, [-1e200, 3.0]), (5, [1e200]),
            (6, [0.1, 0.2, 0.3]), (100, [1e100, 1e100]), (200, [0.1, -0.2, 1e9]), (7, [1e308, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(1024 * x) for x in e] for i, e in rows if all(math.isfinite(1024 * x) for x in e)}
    keep = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = []
    for q, x in whole.items():
        if q % 100 == 0:
            best = sorted((-keep(sum(a * b for a, b in zip(x, y))), i) for i, y in whole.items() if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk_pivots.top_k(df).collect()) == sorted(want)
    assert sorted(tuple(r) for r in topk_pivots.top_k(df, pivots=2, sample=3, block=2, chunk=1).collect()) == sorted(want)


def test_language_sample_with_null_ids_and_repeated_rows(spark):
    long = " ".join("wort%d" % i for i in range(80))
    rows = [(None, long, "de")] * 3 + [(i, long, "de") for i in range(4)] + [(7, "x" * 50_000, "en"), (8, None, "en"), (9, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid_gru.sample_segments(docs)
    assert got and {lang for _, lang in got} <= {"de", "en"}
