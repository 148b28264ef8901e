"""URL rules, hard negatives and spelling variants against plain definitions, with every odd case."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfweave.llm import gnat_negatives as G
from perfweave.llm import spelling_variants as S
from perfweave.llm import url_trie as U

# ------------------------------------------------------------------ URL rules

PAGES = "page_id long, url string, html string, host string, path int, rule string, verdict long"


def plain_match(url, rules, default="allow"):
    """(host, path, rule, verdict) by trying every rule."""
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    best = None
    for h, p, v in rules:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h.split(".")) if h else 0, len(p), v == "block")
            if best is None or key > best[0]:
                best = key, h + p, v
    return (host, path, best[1], best[2]) if best else (host, path, None, default)


ODD_URLS = [None, "", "no scheme", "://", "://com", "://com/", "http://", "http:///x", "HTTP://WWW.Example.COM/en/1?q=/es/",
            "http://example.com", "http://example.com/en", "http://example.com/en/", "http://a.example.com/en/x#y",
            "http://www.example.com/en/z", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/ES/",
            "http://net/es/", "http://xnet/es/", "http://u@example.com:80/en/", "http://example.com:80/en/1", "http://a.com./",
            "http://.com/", "http://a..com/x", "http://x.net//es/", "a://b://c.com/", "http://é.com/\n/en/", "http://x.net/es/" + "y" * 100_000]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block"), ("example.com", "/en", "allow"), ("", "/e", "block"), ("", "/en/", "allow"), ("x.net", "", "allow"),
         ("Example.com", "/en/z", "allow"), ("example.com", "/en/z", "block"), ("a..com", "/x", "block"), ("com", "//", "block")]


def pages(spark, urls):
    return spark.createDataFrame([(i if i != 3 else None, u, "h", "clash", 1, "r", 2) for i, u in enumerate(urls)], PAGES)


@pytest.mark.parametrize("rules", [list(U.RULES), RULES])
@pytest.mark.parametrize("max_rules", [U.MAX_RULES, 0])
def test_url_rules_by_trie_and_by_join(spark, rules, max_rules):
    urls = ODD_URLS + [u for u in ODD_URLS if u][:9] * 3
    got = sorted(((r.page_id is None, r.page_id or 0), r.host, r.path, r.rule, r.verdict)
                 for r in U.judge(pages(spark, urls), rules, max_rules=max_rules).collect())
    want = sorted(((i == 3, 0 if i == 3 else i), *plain_match(u, [(h.lower(), p, v) for h, p, v in rules])) for i, u in enumerate(urls))
    assert got == want


def test_url_rules_random(spark):
    rng = random.Random(5)
    part = lambda n: [rng.choice("ab") for _ in range(rng.randrange(n))]
    rules = [(".".join(part(4)), "/" + "/".join(part(4)) + rng.choice(["", "/"]), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = ["s://" + ".".join(part(5)) + "/" + "/".join(part(6)) for _ in range(400)]
    for max_rules in (U.MAX_RULES, 0):
        got = sorted((r.page_id, r.rule, r.verdict) for r in U.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"),
                                                                  rules, "block", max_rules).collect())
        assert got == [(i, *plain_match(u, rules, "block")[2:]) for i, u in enumerate(urls)]


def test_allowed_pages_keep_their_columns(spark):
    for max_rules in (U.MAX_RULES, 0):
        kept = U.allowed(pages(spark, ODD_URLS), U.RULES, max_rules=max_rules)
        assert kept.columns == PAGES.replace(",", "").split()[::2]
        assert sorted(str(r.url) for r in kept.collect()) == sorted(str(u) for u in ODD_URLS if plain_match(u, U.RULES)[3] == "allow")


def test_url_rules_on_empty_and_wrong_input(spark):
    assert U.judge(pages(spark, ODD_URLS).limit(0), U.RULES).count() == 0
    assert {r.verdict for r in U.judge(pages(spark, ODD_URLS), [], "block").collect()} == {"block"}
    for bad in ([("a", "/", "deny")], [(None, "/", "allow")], [("a", None, "allow")]):
        with pytest.raises(ValueError):
            U.judge(pages(spark, ODD_URLS), bad)


# ------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, score long, chunk int, leaf string"


def plain_negatives(rows, scale=G.SCALE, every=100, move=False):
    """rows: (vec_id, vector, label), one a vec_id -> sorted result."""
    import math
    keep = lambda s: min(max(s, G.LONG_MIN), G.LONG_MAX)
    v = {i: ((l + 1) % 10 if move and i % 7 == 0 else l, [math.floor(scale * x) for x in e]) for i, e, l in rows}
    out = []
    for a, (la, x) in v.items():
        if a % every:
            continue
        s = sorted((-keep(sum(p * q for p, q in zip(x, y))), i, l == la) for i, (l, y) in v.items() if i != a)
        for p, i, _ in [r for r in s if r[2]][:5]:
            fits = [(n, j) for n, j, same in s if not same and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(fits[:5])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, l, 1, 2, "clash") for i, e, l in rows], VECTORS)


def mined(spark, rows, **k):
    return sorted(tuple(r) for r in G.mine(vectors(spark, rows), **k).collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    mid = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        c = i % 6
        x = mid[c] + rng.normal(size=8) * 0.3
        rows.append((i * 5, [float(t) for t in (x if i % 11 else mid[c])], int(c if i % 4 else rng.integers(3))))  # ties: equal vectors
    return rows


@pytest.mark.parametrize("tree", [{}, {"sample": 150, "leaf": 8, "fanout": 4, "block": 64, "chunk": 3}, {"sample": 1}])
def test_negatives_equal_brute_force(spark, clustered, tree):
    want = plain_negatives(clustered)
    assert want and mined(spark, clustered, **tree) == want


def test_negatives_with_moved_labels(spark, clustered):
    assert mined(spark, clustered, label=G.noisy_label) == plain_negatives(clustered, move=True)


def test_the_tree_eliminates_and_loses_nothing(clustered):
    x = np.floor(256 * np.array([e for _, e, _ in clustered]))
    nodes = G.build(x[:300], 6, 10)
    leaf, seen = G.descend(nodes, x)
    extent = {}
    xx = (x * x).sum(1)
    for at, rows, d, side in seen:
        for j in np.unique(side):
            m = side == j
            extent[at, j] = d[m].min(0), d[m].max(0), xx[rows[m]].min(), xx[rows[m]].max()
    visited = 0
    for q in x[::90]:
        s = np.sort(x @ q)
        window = (float(s[-20]), float(s[-5]))
        got = G.leaves_to_visit(nodes, extent, q, [window])
        assert set(leaf[(x @ q >= window[0]) & (x @ q <= window[1])]) <= set(got)
        visited += len(got)
    assert visited < 0.6 * len(x[::90]) * (leaf.max() + 1)


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.9, 5.0], 2), (3, [0.85], 3), (4, [0.9, 5.0], 2), (5, [-1.0], 1), (100, [], 1), (200, [0.0], 2)]
    odd = [(6, None, 1), (7, [1.0, None], 1), (8, [nan], 2), (9, [inf], 2), (10, [1.0], None), (None, [1.0], 2), (11, [1e308], 2)]
    twice = [(2, [3.0], 9), (3, [0.85], 3), (0, [1.0, 0.0], 1)]  # the least (label, vector) counts
    assert mined(spark, rows + odd + twice) == plain_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, odd) == []


def test_negatives_large_components_are_exact(spark):
    rows = [(0, [1e15, 3.0], 1), (1, [2.0, 1e15], 1), (2, [2.0, 1e15 - 5e-1], 2), (3, [1.9999999, 1e15], 2), (4, [1e17, 1e17], 1),
            (5, [1e17, 1e17], 2), (6, [1e200, 0.0], 1), (7, [-1e200, 1.0], 2), (100, [1e200, 1e-3], 2), (8, [3e5, 2e5], 1)]
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_a_very_common_vector(spark):
    rows = [(i, [1.0, 2.0] if i % 3 else [1.0, 2.0 + i / 5000], i % 2) for i in range(1200)]
    assert mined(spark, rows, block=100, chunk=4, sample=200) == plain_negatives(rows)


# ---------------------------------------------------------- spelling variants

DOCS = "doc_id long, text string, lang string, word string, n long, len int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(count, ratio=5):
    out = {}
    for w, n in count.items():
        by = sorted((-m, v) for v, m in count.items() if near(w, v))
        form = by[0][1] if by and -by[0][0] >= ratio * n else None
        out[w] = [form, n, len(by), count[form] if form else None]
    for w, r in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        r.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(4)
    words = {}
    for _ in range(120):
        w = "".join(rng.choice("abéÿ" if rng.random() < 0.5 else "ab") for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 12, 13])))
        words[w] = rng.choice([1, 2, 5, 25, 26, 130, 700])
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            v = rng.choice([w[:i] + w[i + 1:], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1:]])
            if v:
                words.setdefault(v, rng.choice([1, 5, 5, 25]))
    return words


@pytest.mark.parametrize("slice_words", [4096, 7])
def test_variants_equal_brute_force(spark, counts, slice_words):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain_variants(counts)
    assert rows_of(S.variants(frame, slice_words=slice_words)) == want
    assert sum(r[0] is not None for r in want.values()) > 20 and any(r[0] and r[1] != r[0] for r in want.values())


def test_hot_prefix_is_cut_and_loses_no_pair(spark):
    """A third of all words share their front and back: their slice is read in pieces."""
    words = ["common" + a + b + "ending" for a in "abcdefghij" for b in "klmnopqrst"] + ["w%s" % ("x" * i) for i in range(1, 60)]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = sorted(tuple(sorted(p)) for p in S.near_pairs(frame, 16).collect())
    assert got == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_sliced_index_zero_and_one_error():
    index = S.SlicedIndex(["abc", "abd", "abcd", "xabc", "axbc", "ab", "bbc", "abdc"] + ["zz%d" % i for i in range(100, 200)])
    assert sorted(w for _, w in index.near(["abc"])) == [1, 2, 3, 4, 6, 7]


def test_corpus_variants(spark):
    rng = random.Random(8)
    vocab = ["kitten", "sitten", "kittens", "kitteñs", "Flaws", "flawed", "ÀÉÎõüÿ", "straße", "x", "naïvely"]
    texts = [" ".join(rng.choice(vocab) + rng.choice(["", ",", "1", "_"]) for _ in range(80)) for _ in range(30)]
    texts += [None, "", "   ", "KITTEN" * 3, "kitten\x00kitten", "日本語kitten日本語", "longword" * 300_000, "kitten " * 200_000]
    rows = [(i, t, "en", "clash", 1, 2) for i, t in enumerate(texts)] + [(None, "kitten kitten", "x", "y", 1, 1)] * 2 + [(3, texts[3], "", "", 0, 0)]
    for every in (None, S.EVERY, 3):
        count = Counter()
        for d, t, *_ in rows:
            for w in S.RUN.findall((t or "").translate(S._LOWER)):
                h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
                if every and h % every == 0:
                    w = w[:h % len(w)] + w[h % len(w) + 1:]
                count[w] += 1
        want = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
        docs = spark.createDataFrame(rows, DOCS).repartition(3)
        assert rows_of(S.group(docs, every=every)) == plain_variants(want)
    assert S.group(spark.createDataFrame([], DOCS)).count() == 0


def test_pieces_cut_no_run():
    text = "abc de,fghij  klm" * 50
    for size in (1, 2, 5, 64):
        assert "".join(S.pieces(text, size)) == text
        assert [w for p in S.pieces(text, size) for w in S.RUN.findall(p)] == S.RUN.findall(text)


def test_vocabulary_is_null_safe(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string").withColumn("n", F.lit(1))
    assert S.vocabulary(docs).count() == 0
