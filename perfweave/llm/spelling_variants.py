"""Spelling variants: near words by a bit-sliced position index.

Words are runs of letters, counted over all documents; the vocabulary holds
those of at least LETTERS code points and COUNT occurrences.  Two words are
near if one inserted, deleted or replaced code point turns one into the other.

The index of a slice of the vocabulary has, for every position and letter,
the bitset of its words that have the letter there.  A query word is read
letter by letter; three states, each one bit a word, move along: the words
that agree so far without an error (zero errors), those with one replaced
letter, and those with one letter more than the query (one error, their
letters stand one position further).  Each step is a few word-parallel ANDs
and ORs for 64 words at a time, and for many queries at once:

    zero'  = zero & M[i][c]
    same'  = (same & M[i][c]) | (zero & ~M[i][c])
    longer' = (longer | zero) & M[i + 1][c]

Words with one letter less need no state: the pair is found from its shorter
word.  Slices: cut the L letters of a pair's shorter word in PARTS segments;
the error lies in one of them, so the letters before it (counted from the
front) and after it (counted from the back) are equal in both words.  Every
word is listed under the key of every segment, for its own length and as the
longer word of a pair; keys of one length and segment are dealt to slices of
about SLICE words.  A pair counts only in the slice of the first segment whose
outside agrees, so it is found once.  Slices of a frequent key are cut: each
piece of its words is read by each piece of its queries, so no task holds more
than about SLICE words of either kind.

A word's form is its near word with the largest count (ties: the smaller
word) if that is at least RATIO times its own count; roots follow the forms by
pointer doubling (counts grow at every step, so there are no rings).

Defined cases: null texts hold no runs; a null doc_id counts as an empty one
in the hash that plants deletions; repeated rows count each time; very long
texts are read in pieces cut between runs; ties are broken by code points;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import code_on_workers, written

LETTERS, COUNT, RATIO = 6, 5, 5
EVERY = 199      # the registered query deletes a letter of the runs whose hash it divides
PARTS = 3        # segments of a word
SLICE = 4096     # words of a slice
QUERIES = 256    # query words that move along together
PIECE = 1 << 20  # characters of a text read at once
FLUSH = 500_000  # distinct words a task holds before it passes their counts on

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in pieces that cut no run."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            run = RUN.match(text, end)
            end = run.end() if run else end
        yield text[at:end]
        at = end


def planted(doc_id, run: str, every: int) -> str:
    """The run with one letter deleted if ``every`` divides its hash."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, every: int | None = None) -> DataFrame:
    """(word, n): the words of the corpus.  ``every``: deletes letters as ``planted`` does."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for piece in pieces(text or ""):
                    for w, n in Counter(RUN.findall(piece.translate(_LOWER))).items():
                        if every:
                            w = planted(doc_id, w, every)
                        if len(w) >= letters:
                            total[w] += n
                    if len(total) > FLUSH:
                        yield flush()
        yield flush()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def cuts(length: int) -> list[int]:
    """Segment borders of a word of ``length`` letters: PARTS + 1 positions."""
    return [length * j // PARTS for j in range(PARTS + 1)]


def outside_agrees(a: str, b: str, part: int) -> bool:
    """Whether the letters outside segment ``part`` of the shorter word ``a`` are equal in ``b``."""
    c = cuts(len(a))
    rest = len(a) - c[part + 1]
    return a[:c[part]] == b[:c[part]] and a[len(a) - rest:] == b[len(b) - rest:]


class SlicedIndex:
    """Bitsets of a list of words: per position and letter, per length."""

    def __init__(self, words: list[str]):
        self.n, self.lanes = len(words), -(-len(words) // 64)
        self.sets: list[dict[str, np.ndarray]] = []
        self.none = np.zeros(self.lanes, np.uint64)
        bits = [(i >> 6, np.uint64(1) << np.uint64(i & 63)) for i in range(len(words))]
        self.of_length: dict[int, np.ndarray] = {}
        for w, (lane, bit) in zip(words, bits):
            self.of_length.setdefault(len(w), self.none.copy())[lane] |= bit
            while len(self.sets) < len(w):
                self.sets.append({})
            for at, c in zip(self.sets, w):
                if c not in at:
                    at[c] = self.none.copy()
                at[c][lane] |= bit

    def rows(self, position: int, letters: list[str]) -> np.ndarray:
        """The bitsets of one position for one letter of every query."""
        at = self.sets[position] if position < len(self.sets) else {}
        return np.stack([at.get(c, self.none) for c in letters])

    def near(self, queries: list[str]) -> list[tuple[int, int]]:
        """(query, word) for words with exactly one letter replaced or one more; the queries have one length."""
        size = len(queries[0])
        zero = np.full((len(queries), self.lanes), ~np.uint64(0))
        same, longer = np.zeros_like(zero), np.zeros_like(zero)
        here = self.rows(0, [q[0] for q in queries])
        for i in range(size):
            letters = [q[i] for q in queries]
            further = self.rows(i + 1, letters)
            longer = (longer | zero) & further
            same = (same & here) | (zero & ~here)
            zero = zero & here
            if i + 1 < size:
                here = self.rows(i + 1, [q[i + 1] for q in queries])
        hit = (same & self.of_length.get(size, self.none)) | ((longer | zero) & self.of_length.get(size + 1, self.none))
        out = []
        for q, lane in zip(*np.nonzero(hit)):
            bits = int(hit[q, lane])
            while bits:
                low = bits & -bits
                out.append((int(q), int(lane) * 64 + low.bit_length() - 1))
                bits ^= low
        return out


def near_pairs(words: DataFrame, slice_words: int = SLICE) -> DataFrame:
    """(a, b): every near pair of the distinct words of a table (column word) once, |a| <= |b|."""
    import pandas as pd

    length = F.char_length("word")
    # Each word under every segment: as the shorter word or of equal length (L), and as the longer (L - 1).
    listed = words.where(length >= 1).select("word", F.explode(F.array(length, length - 1)).alias("len")).where("len >= 1").select(
        "word", "len", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    front = F.floor(F.col("len") * F.col("part") / F.lit(PARTS)).cast("int")
    back = F.col("len") - F.floor(F.col("len") * (F.col("part") + 1) / F.lit(PARTS)).cast("int")
    key = F.xxhash64(F.substr("word", F.lit(1), front), F.substr("word", F.char_length("word") - back + 1, back))
    listed = written(listed.withColumn("key", key), "listed")
    # Slices of a length and segment, so that one holds about slice_words words; pieces of the slices that hold far more.
    # The number of slices is a small written table, so Spark sends it to the words and not the words to it.
    dealt = written(listed.groupBy("len", "part").agg(F.ceil(F.count(F.lit(1)) / F.lit(slice_words)).alias("slices")), "slices")
    placed = listed.join(dealt, ["len", "part"]).withColumn("slice", F.pmod("key", F.col("slices"))).drop("slices")
    cut = placed.groupBy("len", "part", "slice").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * slice_words)).cast("int").alias("cuts"))
    placed = placed.join(cut, ["len", "part", "slice"]).withColumn("mine", F.pmod(F.hash("word"), F.col("cuts")))
    every = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    targets = placed.select("len", "part", "slice", "word", F.lit(False).alias("asks"), F.col("mine").alias("t"), every.alias("q"))
    asks = placed.where(F.char_length("word") == F.col("len")).select(
        "len", "part", "slice", "word", F.lit(True).alias("asks"), every.alias("t"), F.col("mine").alias("q"))

    def search(f: pd.DataFrame) -> pd.DataFrame:
        part = int(f["part"].iloc[0])
        targets = f["word"][~f["asks"]].tolist()
        asks = f["word"][f["asks"]].tolist()
        found = []
        if targets and asks:
            index = SlicedIndex(targets)
            for at in range(0, len(asks), QUERIES):
                some = asks[at:at + QUERIES]
                for q, w in index.near(some):
                    a, b = some[q], targets[w]
                    if len(a) == len(b) and a > b:
                        continue  # found from b
                    if outside_agrees(a, b, part) and not any(outside_agrees(a, b, p) for p in range(part)):
                        found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"])

    return targets.unionByName(asks).groupBy("len", "part", "slice", "t", "q").applyInPandas(search, "a string, b string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to, by pointer doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.agg(F.coalesce(F.max("moved"), F.lit(False))).collect()[0][0]:  # one value
            return at.drop("moved")
        at = at.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, slice_words: int = SLICE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n)."""
    code_on_workers(words.sparkSession)
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words, slice_words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    # Largest count first, then the smaller word.
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.max("nb").alias("top"))
    named = counted.join(best.select(F.col("a").alias("_a"), "top"), (F.col("a") == F.col("_a")) & (F.col("nb") == F.col("top"))).groupBy("a").agg(
        F.min("b").alias("best"))
    joined = (words.join(best.withColumnRenamed("a", "word"), "word", "left").join(named.withColumnRenamed("a", "word"), "word", "left"))
    strong = F.col("top") >= F.col("n") * F.lit(ratio)
    formed = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("top")).alias("form_n")), "forms")
    ends = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, ratio: int = RATIO, every: int | None = None) -> DataFrame:
    """Spelling variants of the words of a corpus (see ``variants``)."""
    code_on_workers(docs.sparkSession)
    return variants(vocabulary(docs, letters, count, every), ratio)


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
per AS (SELECT d, w, count(*) AS k, hex(encode(d || ':' || w)) AS x FROM runs GROUP BY d, w),
hashed AS (SELECT w, k, xor(list_reduce([4294967295] || list_transform(range(length(x) // 2),
    lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS h FROM per, bits),
cut AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
voc AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM voc, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (SELECT DISTINCT a, b FROM (
  SELECT x.word AS a, y.word AS b FROM gap x JOIN gap y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT x.word, y.word FROM gap x JOIN voc y ON x.rest = y.word
  UNION ALL SELECT y.word, x.word FROM gap x JOIN voc y ON x.rest = y.word)),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS top FROM near JOIN voc ON word = b GROUP BY a),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN b END AS form,
                  CASE WHEN top >= 5 * n THEN top END AS form_n FROM voc LEFT JOIN best ON a = word),
walk(word, root) AS (SELECT word, word FROM formed UNION ALL
                     SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN formed ON formed.word = walk.root WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
