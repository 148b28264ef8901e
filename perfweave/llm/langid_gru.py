"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a segment's bytes in both directions (two GRUs), labels
every byte with language log-probabilities, and a document's probabilities
pool those of all its bytes (mean log-probability, normalised).  A segment is
one word with its leading space, lower-cased; longer words are several
segments.  The state starts at zero in each segment, so the labels of a
segment depend on its bytes alone, and a worker labels each distinct segment
once for many documents.

Training: numpy, backpropagation through time, Adam, on the segments of a
bounded sample of labelled documents (``SAMPLE_DOCS`` documents by hash, at
most ``SAMPLE_WORDS`` segments of each, drawn over the whole text), with
classes weighted by inverse frequency.  Only text and language are read.

Defined cases: null text or a text without a letter gives ``und`` with score
0; so does any text when no labelled row exists; repeated rows are predicted
row by row; rows with null language are no training rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import code_on_workers

SAMPLE_DOCS = 3000
SAMPLE_WORDS = 25
SEGMENT = 32  # bytes
HIDDEN = 8
MEMO_SEGMENTS = 300_000

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)  # also finds signs such as a superscript two
    return m is not None and (m[0].isalpha() or any(map(str.isalpha, text)))


def segments(text: str) -> list[bytes]:
    """Segments of a text: words with a leading space, cut at SEGMENT bytes."""
    out = []
    for w in text.lower().split():
        b = b" " + w.encode("utf-8", "replace")
        if len(b) <= SEGMENT:
            out.append(b)
        else:
            out.extend(b[i:i + SEGMENT] for i in range(0, len(b), SEGMENT))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two GRUs over bytes and a softmax on every position."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng, h = np.random.default_rng(seed), hidden
        self.classes, self.h = classes, hidden
        self.p = {f"{k}{d}": v.astype(np.float32) for d in (0, 1) for k, v in (
            ("E", rng.normal(0, 0.3, (256, 3 * h))), ("U", rng.normal(0, 0.3, (h, 3 * h))),
            ("O", rng.normal(0, 0.3, (h, len(classes)))))}
        self.p["b"] = np.zeros(len(classes), np.float32)

    def _scan(self, x: np.ndarray, d: int, keep: list | None = None) -> list[np.ndarray]:
        """States of direction d after each byte of x (segments x bytes)."""
        h, e, u = self.h, self.p[f"E{d}"], self.p[f"U{d}"]
        state, out = np.zeros((len(x), h), np.float32), [None] * x.shape[1]
        for t in (range(x.shape[1]) if d == 0 else range(x.shape[1] - 1, -1, -1)):
            xw, hu = e[x[:, t]], state @ u
            zr = _sigmoid(xw[:, :2 * h] + hu[:, :2 * h])
            n = np.tanh(xw[:, 2 * h:] + zr[:, h:] * hu[:, 2 * h:])
            new = n + zr[:, :h] * (state - n)
            if keep is not None:
                keep.append((t, state, zr, n, hu[:, 2 * h:]))
            state = out[t] = new
        return out

    def _log_softmax(self, fw: np.ndarray, bw: np.ndarray) -> np.ndarray:
        y = fw @ self.p["O0"] + bw @ self.p["O1"] + self.p["b"]
        y -= y.max(1, keepdims=True)
        return y - np.log(np.exp(y).sum(1, keepdims=True))

    def label(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of every byte: segments x bytes x classes."""
        fw, bw = self._scan(x, 0), self._scan(x, 1)
        return np.stack([self._log_softmax(a, b) for a, b in zip(fw, bw)], 1)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean cross-entropy of all positions and its gradients."""
        h, keep = self.h, ([], [])
        states = [self._scan(x, d, keep[d]) for d in (0, 1)]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss, scale = 0.0, (weight / (weight.sum() * x.shape[1]))[:, None]
        back = [[None] * x.shape[1] for _ in (0, 1)]
        rows = np.arange(len(x))
        for t in range(x.shape[1]):
            lp = self._log_softmax(states[0][t], states[1][t])
            loss -= float((lp[rows, y] * scale[:, 0]).sum())
            dy = np.exp(lp)
            dy[rows, y] -= 1
            dy *= scale
            g["b"] += dy.sum(0)
            for d in (0, 1):
                g[f"O{d}"] += states[d][t].T @ dy
                back[d][t] = dy @ self.p[f"O{d}"].T
        for d in (0, 1):
            u, carry = self.p[f"U{d}"], np.zeros((len(x), h), np.float32)
            for t, prev, zr, n, hn in reversed(keep[d]):
                dh = back[d][t] + carry
                z, r = zr[:, :h], zr[:, h:]
                dn = dh * (1 - z) * (1 - n * n)
                da = np.concatenate([dh * (prev - n) * z * (1 - z), dn * hn * r * (1 - r), dn], 1)
                np.add.at(g[f"E{d}"], x[:, t], da)
                da[:, 2 * h:] = dn * r
                g[f"U{d}"] += prev.T @ da
                carry = dh * z + da @ u.T
        return loss, g


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, epochs: int = 3, batch: int = 256,
          rate: float = 0.01, seed: int = 0) -> Network | None:
    """Fit a network on (segment, language) pairs."""
    if not samples:
        return None
    classes = sorted({c for _, c in samples})
    net, rng = Network(classes, hidden, seed), np.random.default_rng(seed)
    code = {c: i for i, c in enumerate(classes)}
    y = np.array([code[c] for _, c in samples])
    share = len(y) / np.bincount(y, minlength=len(classes)) / len(classes)
    lengths = np.array([len(s) for s, _ in samples])
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in (0, 1))
    step = 0
    total = epochs * sum(-(-int((lengths == n).sum()) // batch) for n in np.unique(lengths))
    for _ in range(epochs):
        batches = []
        for n in np.unique(lengths):
            at = rng.permutation(np.flatnonzero(lengths == n))
            batches += [at[i:i + batch] for i in range(0, len(at), batch)]
        for k in rng.permutation(len(batches)):
            at = batches[k]
            x = np.frombuffer(b"".join(samples[i][0] for i in at), np.uint8).reshape(len(at), -1)
            _, g = net.gradients(x, y[at], share[y[at]].astype(np.float32))
            step += 1
            lr = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for name, grad in g.items():
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.001 * (grad * grad - v[name])
                net.p[name] -= (lr * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return net


def training_rows(doc_id: Column) -> Column:
    """Rows that may be learned from: the checksum rule of the contract."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 != 2, F.lit(False))


def sample_segments(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_words: int = SAMPLE_WORDS) -> list[tuple[bytes, str]]:
    """At most 2 x n_docs x n_words labelled segments, by hash of doc_id."""
    code_on_workers(docs.sparkSession)
    labelled = docs.where(training_rows(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, n_docs / max(1, labelled.count()))
    few = labelled.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def draw(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for i, text, lang in zip(f["doc_id"], f["text"], f["lang"]):
                s = [x for x in segments(text) if has_letter(x.decode("utf-8", "ignore"))]
                if len(s) > n_words:
                    s = [s[j] for j in np.random.default_rng(abs(int(i))).choice(len(s), n_words, False)]
                rows += [(x, lang) for x in s]
            yield pd.DataFrame(rows, columns=["s", "lang"])

    # A null doc_id draws like 0 (pandas would turn the whole column into floats).
    seed = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id")
    got = few.select(seed, "text", "lang").mapInPandas(draw, "s binary, lang string").limit(2 * n_docs * n_words)
    return sorted((bytes(r["s"]), r["lang"]) for r in got.collect())


class Memo(dict):
    """Index of each distinct segment; new ones wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, s: bytes) -> int:
        self[s] = n = len(self)
        self.new.append(s)
        return n


def _label_new(net: Network, new: list[bytes]) -> np.ndarray:
    """Summed log-probabilities and byte count of each new segment."""
    out = np.empty((len(new), len(net.classes) + 1), np.float64)
    lengths = np.array([len(s) for s in new], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 2048):
            part = at[i:i + 2048]
            x = np.frombuffer(b"".join([new[k] for k in part]), np.uint8).reshape(len(part), n)
            out[part, :-1] = net.label(x).sum(1)
            out[part, -1] = n
    return out


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    import pyarrow as pa

    code_on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = Memo(), np.empty((0, 0))
        for b in batches:
            if len(memo) > MEMO_SEGMENTS:
                memo, table = Memo(), np.empty((0, 0))
            ids, ends = [], [0]
            letters = []
            for text in b.column(1):
                text = text.as_py()
                ok = text is not None and net is not None and has_letter(text)
                letters.append(ok)
                if ok:
                    ids += map(memo.__getitem__, segments(text))
                ends.append(len(ids))
            pred, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            if ids:
                if memo.new:
                    fresh = _label_new(net, memo.new)
                    table = np.concatenate([table, fresh]) if len(table) else fresh
                    memo.new.clear()
                at = np.flatnonzero(letters)
                sums = np.add.reduceat(table[np.array(ids)], np.array(ends[:-1])[at], 0)
                mean = sums[:, :-1] / sums[:, -1:]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for k, row in zip(at, p):
                    pred[k], score[k] = net.classes[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    net = train(sample_segments(docs))
    return predict(docs, net).select("doc_id", (~training_rows(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
