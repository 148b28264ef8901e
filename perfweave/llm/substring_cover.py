"""Substring removal by difference-cover anchors.

A window is WINDOW consecutive words.  Each word covered by a window that also
starts in a document with a smaller doc_id is removed; windows are judged on
the input.

Anchors.  COVER is a difference cover modulo PERIOD: any two positions i, j
have an offset d < PERIOD with (i + d) and (j + d) both in the cover.  Only
the short windows of ANCHOR = WINDOW - PERIOD + 1 words that start at cover
positions are hashed.  Two equal windows at i and j therefore share the
anchor at offset d, aligned and inside the window.  Anchors found in one
document only cannot lie in a repeated window at that offset, so a window is
a candidate only if one of its anchors occurs in two or more documents.
Candidates are then extended to all WINDOW words: their 128-bit hashes meet
once, and the smallest doc_id of each is the verdict.

Flow.  Documents are dealt to blocks by hash of doc_id (one shuffle, reused).
A block sends each distinct anchor once, whatever its number of copies, so
the most common passage brings one row per block and no hot key; the reply
to a block is the list of its anchors that occur elsewhere too.  Candidate
windows travel the same way, with the block's smallest doc_id.  A block is a
bounded number of documents; nothing else is ever gathered.

Defined cases: null and blank texts have no words; a null doc_id counts as
larger than all others and removes nothing; rows with equal doc_id remove
nothing from one another; documents of fewer than WINDOW words stay whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm import wordhash as H
from perfweave.llm.common import code_on_workers

WINDOW = 50
# Perfect difference set of order 5: fixed values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_DOCS, BUCKET_DOCS = 1500, 4000  # documents per block, and per bucket of hashes
LEAST_KEYS = 64
NO_ID = np.iinfo(np.int64).max


def encode(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def anchor_positions(n_words: int) -> np.ndarray:
    """Cover positions at which a whole anchor fits."""
    n = n_words - ANCHOR + 1
    if n_words < WINDOW:
        return np.empty(0, np.int64)
    p = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return p[p < n]


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text's anchors."""
    words, _, _ = H.word_hashes(text)
    at = anchor_positions(len(words))
    return (H.window_hashes(words, ANCHOR, at, 1) if len(at) else np.empty(0, H.U64)), at


def candidates(text: bytes, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hash, second hash) of the windows that hold a shared anchor.

    ``shared`` is sorted.  The cover is a perfect difference set, so each
    window holds several anchors; one of them is enough.
    """
    words, _, _ = H.word_hashes(text)
    at = anchor_positions(len(words))
    none = np.empty(0, np.int64), np.empty(0, H.U64), np.empty(0, H.U64)
    if not len(at) or not len(shared):
        return none
    h = H.window_hashes(words, ANCHOR, at, 1)
    hit = at[shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h]
    n = len(words) - WINDOW + 1
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(hit - (PERIOD - 1), 0), 1)
    np.add.at(mark, np.minimum(hit + 1, n), -1)
    starts = np.flatnonzero(np.cumsum(mark[:n]) > 0)
    if not len(starts):
        return none
    second, _, _ = H.word_hashes(text, 1)
    return starts, H.window_hashes(words, WINDOW, starts, 2), H.window_hashes(second, WINDOW, starts, 3)


def _least(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) with their smallest id and whether they have two ids."""
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a))[:len(first)] - 1
    return a[first], b[first], ids[first], ids[first] != ids[last]


def _least_of_each(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every entry, the smallest id among the entries with equal (a, b)."""
    order = np.lexsort((ids, b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), np.int64)
    if len(a):
        out[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _deal(h: np.ndarray, buckets: int, *more: np.ndarray):
    """(bucket, bytes of each array) of the hashes dealt to buckets."""
    to = ((h >> H.U64(32)) * H.U64(buckets)) >> H.U64(32)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cut = np.flatnonzero(np.diff(to, prepend=to[:1] + H.U64(1))) if len(to) else []
    for lo, hi in zip(cut, [*cut[1:], len(to)]):
        yield int(to[lo]), [x[order[lo:hi]].tobytes() for x in (h, *more)]


def _joined(column, kind) -> np.ndarray:
    """Arrays stored as bytes in rows, joined."""
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def _slices(column) -> list[slice]:
    """Place of each row's 8-byte numbers in the joined array."""
    ends = np.cumsum([len(x) // 8 for x in column])
    return [slice(int(a), int(b)) for a, b in zip([0, *ends], ends)]


def repeated(docs: DataFrame, block_docs: int = BLOCK_DOCS, bucket_docs: int = BUCKET_DOCS,
             as_sha256: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept text (or its sha256)."""
    import pandas as pd

    code_on_workers(docs.sparkSession)
    # Set by the data, not by the number of partitions: a block sends at most
    # one row to each bucket, and never more rows than it has hashes.
    total = docs.count()
    blocks, buckets = (max(LEAST_KEYS, -(-total // n)) for n in (block_docs, bucket_docs))
    dealt = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                        F.col("doc_id").isNull().alias("no_id"), "text",
                        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))

    def send_anchors(key, f):
        rows = []
        own = [anchors(encode(t))[0] for t in f["text"]]
        h = np.concatenate(own)
        # Two rows of one document count as two: a null doc_id has no order.
        h, _, _, twice = _least(h, np.zeros(len(h), np.int8), np.repeat(np.arange(len(own)), [len(x) for x in own]))
        for bucket, (hb, tb) in _deal(h, buckets, twice.astype(np.int8)):
            rows.append((bucket, key[0], hb, tb))
        return pd.DataFrame(rows, columns=["bucket", "block", "h", "twice"])

    def share_anchors(key, f):
        """Anchors of two or more documents, back to every block that has them."""
        h = _joined(f["h"], H.U64)
        twice = _joined(f["twice"], np.int8)
        distinct, back, count = np.unique(h, return_inverse=True, return_counts=True)
        good = (count > 1) | (np.bincount(back, twice, len(distinct)) > 0)
        keep = good[back]
        rows = [(int(b), h[at][keep[at]].tobytes()) for b, at in zip(f["block"], _slices(f["h"])) if keep[at].any()]
        return pd.DataFrame(rows, columns=["block", "h"])

    sent = dealt.groupBy("block").applyInPandas(send_anchors, "bucket int, block int, h binary, twice binary")
    shared = sent.groupBy("bucket").applyInPandas(share_anchors, "block int, h binary")

    def windows_of(f, s):
        """Per document: (row, starts, hash, second hash) of its candidates."""
        known = np.unique(np.concatenate([np.frombuffer(x, H.U64) for x in s["h"]])) if len(s) else np.empty(0, H.U64)
        return [candidates(encode(t), known) for t in f["text"]]

    def send_windows(key, f, s):
        found = windows_of(f, s)
        ids = np.repeat(f["id"].to_numpy(), [len(x[0]) for x in found])
        rows = []
        if len(ids):
            a, b, least, _ = _least(np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]), ids)
            for bucket, (ab, bb, lb) in _deal(a, buckets, b, least):
                rows.append((bucket, key[0], ab, bb, lb))
        return pd.DataFrame(rows, columns=["bucket", "block", "a", "b", "least"])

    def share_windows(key, f):
        """Windows of other blocks with a smaller id, back to every block that has them."""
        a, b, ids = _joined(f["a"], H.U64), _joined(f["b"], H.U64), _joined(f["least"], np.int64)
        least = _least_of_each(a, b, ids)
        keep = least < ids
        rows = [(int(block), *(x[at][keep[at]].tobytes() for x in (a, b, least)))
                for block, at in zip(f["block"], _slices(f["a"])) if keep[at].any()]
        return pd.DataFrame(rows, columns=["block", "a", "b", "least"])

    in_block = dealt.groupBy("block")
    windows = in_block.cogroup(shared.groupBy("block")).applyInPandas(
        send_windows, "bucket int, block int, a binary, b binary, least binary")
    smaller = windows.groupBy("bucket").applyInPandas(share_windows, "block int, a binary, b binary, least binary")
    # Everything a block needs for its verdicts: shared anchors (h), smaller windows (a, b, least).
    replies = shared.unionByName(smaller, allowMissingColumns=True)

    def cut(key, f, s):
        found = windows_of(f, s[s["h"].notna()])
        w = s[s["a"].notna()]
        ids, size = f["id"].to_numpy(), np.array([len(x[0]) for x in found])
        n_own = int(size.sum())
        a, b, own = (np.concatenate([*mine, *(np.frombuffer(x, kind) for x in w[col])]) for col, kind, mine in (
            ("a", H.U64, [x[1] for x in found]), ("b", H.U64, [x[2] for x in found]),
            ("least", np.int64, [np.repeat(ids, size)])))
        least = np.split(_least_of_each(a, b, own)[:n_own], np.cumsum(size)[:-1])
        rows = []
        for i, (doc, none, t) in enumerate(zip(f["id"], f["no_id"], f["text"])):
            text = encode(t)
            words = text.split()
            n, removed = len(words), 0
            starts = found[i][0][least[i] < ids[i]]
            if len(starts):
                mark = np.zeros(n + 1, np.int64)
                mark[starts] += 1
                mark[starts + WINDOW] -= 1
                gone = np.cumsum(mark[:n]) > 0
                removed = int(gone.sum())
                words = [x for x, g in zip(words, gone) if not g]
            kept = b" ".join(words)
            rows.append((int(doc), bool(none), n, removed,
                         hashlib.sha256(kept).hexdigest() if as_sha256 else kept.decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["id", "no_id", "n_words", "n_removed", column])

    column = "kept_sha256" if as_sha256 else "kept"
    return in_block.cogroup(replies.groupBy("block")).applyInPandas(
        cut, f"id long, no_id boolean, n_words long, n_removed long, {column} string").select(
            F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_words", "n_removed", column)


def digest(docs: DataFrame) -> DataFrame:
    return repeated(docs, as_sha256=True)
