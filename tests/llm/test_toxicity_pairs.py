"""Pairs of terms that tell only together."""

import numpy as np

from perfweave.llm import toxicity_fm


def _samples(seed, n=4000):
    """Terms 1 and 2 have equal shares in both classes; both together are toxic.  Term 3 is toxic by itself."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        kind = rng.choice(["pair", "alone", "clean"], p=[0.045, 0.105, 0.85])
        with_one = {"pair": [1, 2], "alone": [3], "clean": [[1], [2], [], []][rng.choice(4, p=[0.3, 0.3, 0.2, 0.2])]}[kind]
        slots = np.unique(np.concatenate([rng.integers(100, 800, 40), with_one])).astype(np.int32)
        out.append((slots, int(kind != "clean")))
    return out


def test_toxicity_learns_a_pair_with_equal_shares_in_both_classes():
    samples = _samples(0)
    alone = toxicity_fm.informative(samples, 1 << toxicity_fm.BITS)
    assert not alone[1] and not alone[2] and alone[3]
    m = toxicity_fm.train(samples)
    rows = m.rows()
    fresh = _samples(1)
    p = toxicity_fm.probability(m.bias, np.stack([rows[s].sum(0) for s, _ in fresh])) >= 0.5
    both = np.array([{1, 2} <= set(s.tolist()) for s, _ in fresh])
    clean = np.array([t == 0 for _, t in fresh])
    assert p[both].mean() > 0.9 and p[clean].mean() < 0.05


def test_neutral_terms_pass_no_screen():
    rng = np.random.default_rng(2)
    samples = [(np.unique(rng.integers(100, 800, 40)).astype(np.int32), int(rng.random() < 0.1)) for _ in range(3000)]
    alone = toxicity_fm.informative(samples, 1 << toxicity_fm.BITS)
    assert (alone | toxicity_fm.paired(samples, alone)).sum() <= 2
    assert not toxicity_fm.paired([(np.empty(0, np.int32), 1)], alone).any()
