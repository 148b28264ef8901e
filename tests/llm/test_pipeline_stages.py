"""Stages of the corpus pipeline against plain definitions, at the stages' own settings."""

import random

import brute
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def _near_copies(texts, size, percent):
    """Ids that go: brute force over all pairs; of each component the smallest id stays."""
    sets = {}
    for i, t in texts:
        w = brute.words(t.translate(brute.LOWER))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    top = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and top[a] != top[b]:
                low, high = sorted((top[a], top[b]))
                top = {i: low if t == high else t for i, t in top.items()}
    return {i for i in top if top[i] != i}


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"w{g}x{k}" for k in range(100)]
        texts.append((10 * g, " ".join(base)))
        for copy in range(1, 5):  # as many changed words, far apart: J5 = (96 - 5c) / (96 + 5c)
            w, shift = list(base), rng.randrange(10)
            for c in range(copy):
                w[10 + shift + 20 * c] = f"changed{g}{copy}{c}"
            texts.append((10 * g + copy, " ".join(w)))
    two = [f"v{k}" for k in range(100)]  # the two-word case alone: 86/106 of five words, 92/104 of three
    changed = [{30: "other", 70: "words"}.get(k, w) for k, w in enumerate(two)]
    texts += [(500, " ".join(two)), (501, " ".join(changed)), (502, "a few words"), (503, "a few words"), (504, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    gone = {i for i, _ in texts} - kept
    assert 501 in gone and 503 in gone
    assert gone == _near_copies(texts, 5, 80)
