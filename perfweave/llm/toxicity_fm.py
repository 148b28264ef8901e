"""Toxicity scores by a factorization machine over hashed terms.

The terms of a text are its distinct lower-cased words and their distinct
four-letter beginnings, hashed to ``2 ** BITS`` slots (a slot counts once).  The score is the
logistic of

    b + sum_i w_i + 1/2 (|sum_i v_i|^2 - sum_i |v_i|^2),

so besides each term's weight w every pair of terms contributes the inner
product of their vectors v: pairs such as an insult and a group mention count
although each alone may be harmless.  Long texts hold many neutral terms; a
term in ``MIN_DOCS`` training documents takes part if it tells alone or beside
another term.  Alone: its shares among toxic and other documents differ by
``MIN_Z`` standard errors.  In a pair: among the documents that hold some
other term, its shares differ by ``PAIR_Z`` standard errors (more, as all
pairs of terms are tested), and ``PAIR_DOCS`` documents hold both (fewer give
no reliable test); both terms of the pair then take part.  Terms that only a
pair brought in learn slower and decay (``PAIR_START``, ``PAIR_DECAY``).

Training: numpy, AdaGrad on logistic loss, on a bounded sample of labelled
documents (``SAMPLE_DOCS`` by hash; documented bound).  Rows that may be
learned from are those whose checksum rule of the contract holds.

Defined cases: null and empty texts have no terms and get the score of the
bias; without labelled rows every score is 0; a document with several labels
counts as toxic when any of them says so; rows with null label or doc_id are
no training rows; repeated rows are scored row by row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import code_on_workers
from perfweave.operators.joins import bounded_broadcast

SAMPLE_DOCS = 12_000
BITS = 18
FACTORS = 4
MIN_DOCS = 4
MIN_Z = 4.0
PAIR_DOCS = 32
PAIR_Z = 9.0
PAIR_DECAY = 0.3
PAIR_START = 30.0  # first squared-gradient sum of their weights
PAIR_BLOCK = 1024  # terms counted against as many others at once
MEMO_TERMS = 400_000

# Bytes of words: ASCII letters and everything beyond ASCII; the rest divides words.
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def distinct_words(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def slots_of(word: bytes) -> tuple[int, int]:
    """Slots of a word and of its beginning (marked by ``^``)."""
    start = "^" + word.decode("utf-8", "replace")[:4]
    mask = (1 << BITS) - 1
    return zlib.crc32(word) & mask, zlib.crc32(start.encode("utf-8", "replace")) & mask


class Memo(dict):
    """Index of each distinct word; slot pairs by index."""

    def __init__(self):
        super().__init__()
        self.slots: list[tuple[int, int]] = []
        self.table = np.empty((1024, 2), np.int32)
        self.filled = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.slots)
        self.slots.append(slots_of(word))
        return n

    def of(self, text: str) -> np.ndarray:
        """Distinct slots of a text."""
        at = list(map(self.__getitem__, distinct_words(text)))
        n = len(self.slots)
        if self.filled < n:
            if n > len(self.table):
                self.table = np.resize(self.table, (2 * n, 2))
            self.table[self.filled:n] = self.slots[self.filled:]
            self.filled = n
        return np.unique(self.table[at]) if at else np.empty(0, np.int32)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # slots
    factor: np.ndarray  # slots x FACTORS

    def rows(self) -> np.ndarray:
        """What each slot adds to a text: weight, vector, squared length."""
        v = self.factor
        return np.concatenate([self.weight[:, None], v, (v * v).sum(1, keepdims=True)], 1)


def probability(bias: float, sums: np.ndarray) -> np.ndarray:
    """Scores of texts from the sums of their slots' rows."""
    z = bias + sums[:, 0] + 0.5 * ((sums[:, 1:-1] ** 2).sum(1) - sums[:, -1])
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def informative(samples: list[tuple[np.ndarray, int]], n: int) -> np.ndarray:
    """Slots whose share among toxic and other texts differs by MIN_Z standard errors."""
    y = np.array([t for _, t in samples])
    k1, k0 = (np.bincount(np.concatenate([s for s, t in samples if t == c] or [np.empty(0, int)]), minlength=n)
              for c in (1, 0))
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    share = (k1 + k0) / (n1 + n0)
    error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) + 1e-12
    return (k1 + k0 >= MIN_DOCS) & (np.abs(k1 / n1 - k0 / n0) >= MIN_Z * error)


def paired(samples: list[tuple[np.ndarray, int]], alone: np.ndarray) -> np.ndarray:
    """Slots of pairs whose one slot tells the classes apart where the other
    stands, and not by itself (``alone``)."""
    size = PAIR_BLOCK
    y = np.array([t for _, t in samples])
    place = np.empty(len(y), np.int64)  # toxic texts first
    place[np.argsort(-y, kind="stable")] = np.arange(len(y))
    toxic = int((y > 0).sum())
    slot = np.concatenate([s for s, _ in samples])
    doc = np.repeat(place, [len(s) for s, _ in samples])
    terms = np.flatnonzero(np.bincount(slot, minlength=len(alone)) >= PAIR_DOCS)
    at = np.full(len(alone), -1)
    at[terms] = np.arange(len(terms))
    doc, slot = doc[at[slot] >= 0], at[slot[at[slot] >= 0]]
    order = np.argsort(slot, kind="stable")
    doc, slot = doc[order], slot[order]
    blocks = -(-len(terms) // size)
    ends = np.searchsorted(slot, np.arange(blocks + 1) * size)
    n1, n0 = (np.bincount(slot[c], minlength=blocks * size).astype(np.float32) for c in (doc < toxic, doc >= toxic))
    weak, found = np.zeros(blocks * size, bool), np.zeros(blocks * size, bool)
    weak[:len(terms)] = ~alone[terms]

    def block(i):  # texts x terms
        x = np.zeros((len(y), size), np.float32)
        x[doc[ends[i]:ends[i + 1]], slot[ends[i]:ends[i + 1]] - i * size] = 1
        return x

    def tells(k1, k0, a1, a0):  # second term's shares among the first's texts
        share = (k1 + k0) / (a1 + a0)
        error = np.sqrt(share * (1 - share) * (1 / a1 + 1 / a0)) + 1e-12
        return (k1 + k0 >= PAIR_DOCS) & (a1 > 0) & (a0 > 0) & (np.abs(k1 / a1 - k0 / a0) >= PAIR_Z * error)

    with np.errstate(all="ignore"):
        for i in range(blocks):
            x, rows = block(i), slice(i * size, (i + 1) * size)
            for j in range(i, blocks):
                z, cols = x if i == j else block(j), slice(j * size, (j + 1) * size)
                k1, k0 = x[:toxic].T @ z[:toxic], x[toxic:].T @ z[toxic:]
                ok = tells(k1, k0, n1[rows, None], n0[rows, None]) & weak[cols]
                ok |= tells(k1, k0, n1[cols], n0[cols]) & weak[rows, None]
                found[rows] |= ok.any(1)
                found[cols] |= ok.any(0)
    out = np.zeros(len(alone), bool)
    out[terms] = found[:len(terms)]
    return out


def train(samples: list[tuple[np.ndarray, int]], epochs: int = 30, batch: int = 64, rate: float = 0.2,
          decay: float = 1e-5, toxic_weight: float = 2.0,
          start: float = 1.0, vstart: float = 10.0, seed: int = 0) -> Machine | None:
    """Fit a machine on (distinct slots of a text, label) pairs."""
    if not samples:
        return None
    n, rng = 1 << BITS, np.random.default_rng(seed)
    alone = informative(samples, n)
    used = alone | paired(samples, alone)
    rows = [s[used[s]] for s, _ in samples]
    y = np.array([t for _, t in samples], np.float64)
    pos = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w, v = np.zeros(n), rng.normal(0, 0.005, (n, FACTORS)) * used[:, None]
    # Squared-gradient sums start at values that keep rare, noisy slots slow.
    b, hw, hv, hb = float(np.log(pos / (1 - pos))), np.where(alone, start, PAIR_START), np.full((n, FACTORS), vstart), 1.0
    decays = np.where(alone, decay, PAIR_DECAY)[:, None]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), batch):
            part = order[first:first + batch]
            size = np.array([len(rows[i]) for i in part])
            if not size.sum():
                continue
            slots, back = np.unique(np.concatenate([rows[i] for i in part]), return_inverse=True)
            doc = np.repeat(np.arange(len(part)), size)
            k, d = len(slots), len(part)

            def by_doc(x):  # sums over a text's slots
                return np.bincount(doc, x[back], d)

            ws, vs = w[slots], v[slots]
            s = np.stack([by_doc(vs[:, f]) for f in range(FACTORS)], 1)
            z = b + by_doc(ws) + 0.5 * ((s * s).sum(1) - by_doc((vs * vs).sum(1)))
            err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[part]) * np.where(y[part] > 0, toxic_weight, 1.0)
            here = err[doc]
            seen = np.bincount(back, here, k)
            gw = seen + decays[slots, 0] * ws
            gv = np.stack([np.bincount(back, here * s[doc, f], k) for f in range(FACTORS)], 1)
            gv += (decays[slots] - seen[:, None]) * vs
            hw[slots] += gw * gw
            hv[slots] += gv * gv
            hb += err.sum() ** 2
            w[slots] -= rate * gw / np.sqrt(hw[slots])
            v[slots] -= rate * gv / np.sqrt(hv[slots])
            b -= rate * err.sum() / np.sqrt(hb)
    return Machine(b, w, v)


def training_rows(doc_id: Column) -> Column:
    """Rows that may be learned from: the checksum rule of the contract."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, n_docs: int = SAMPLE_DOCS) -> list[tuple[np.ndarray, int]]:
    """About n_docs labelled documents, by hash of doc_id, as (slots, label)."""
    code_on_workers(docs.sparkSession)
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training_rows(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic")))
    share = min(1.0, n_docs / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64(F.col("_id"), F.lit("toxic")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def draw(frames):
        import pandas as pd

        memo = Memo()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "toxic": f["toxic"],
                                "slots": [memo.of(t or "").tobytes() for t in f["text"]]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        bounded_broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_toxic").cast("int").alias("toxic"))
    got = texts.mapInPandas(draw, "doc_id long, toxic int, slots binary").limit(2 * n_docs).collect()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["slots"]))
    return [(np.frombuffer(r["slots"], np.int32), int(r["toxic"])) for r in got]


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) of every row."""
    import pyarrow as pa

    code_on_workers(docs.sparkSession)
    # 2 ** BITS x (FACTORS + 2) numbers, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(
        None if machine is None else (machine.bias, machine.rows().astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for b in batches:
            if len(memo) > MEMO_TERMS:
                memo = Memo()
            got = np.zeros(b.num_rows)
            if shared.value is not None:
                bias, rows = shared.value
                slots = [memo.of(text.as_py() or "") for text in b.column(1)]
                size = np.array([len(s) for s in slots])
                sums = np.zeros((b.num_rows, FACTORS + 2))
                at = np.flatnonzero(size)
                if len(at):
                    ends = np.cumsum(size) - size
                    sums[at] = np.add.reduceat(rows[np.concatenate(slots)], ends[at], 0, np.float64)
                got = probability(bias, sums)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    machine = train(sample(docs, labels))
    return score(docs, machine).select(
        "doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
