"""Best-fit packing of tokenised documents by bulk-synchronous sweeps.

Documents are tokenised where they lie (Arrow batches) and cut into pieces of
at most ``capacity`` tokens.  Lengths are whole numbers up to ``capacity``,
so range-sorting pieces and gaps means giving each its length class and a
rank inside that class.  The ranks come from a distributed two-level count:
rows are dealt to (length, bucket) groups, a running sum over the bucket
counts gives each group's first rank, and ``row_number`` gives the rest.

Sweep: length classes go from long to short.  The pieces of a class are
matched to gaps by successor (smallest gap that holds them first), piece
rank r to gap rank r, so no two pieces want one place; gaps are updated, and
the next class follows.  What finds no gap opens new sequences.  A run of
equal gaps is an interval of sequence numbers, so one sweep moves whole
intervals: the sweeps see only the number of pieces per class (at most
``capacity`` numbers, whatever the corpus) and yield intervals
(length, first rank, last rank, sequence, offset), to which the pieces are
joined by their rank.  This is best-fit decreasing, exactly.

Defined cases: a null or empty text is its end token alone; repeated rows are
packed as documents of their own; an empty table gives an empty result;
null doc_ids are kept; other columns are ignored.  A text of any length is
tokenised as a whole, and its pieces need no order beyond (doc_id, piece).
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm.common import code_on_workers, written

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 50_000
MEMO_ENTRIES = 600_000  # distinct words remembered by one Python worker

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN_SCHEMA = "length long, lo long, hi long, per long, seq long, at long"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Coder(dict):
    """Token ids of a text as little-endian 32-bit bytes.

    The vocabulary splits a text before every single space that precedes a
    word, so the text's ids are those of its space-separated words in order;
    the ids of a word are remembered.  Texts with other spacing, or with the
    vocabulary's special string, are encoded whole.
    """

    plain = re.compile(r"[\n!-~¡-ɏ]+").fullmatch

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.fast = self._ranks(path)

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary in its rank form, faster on single words."""
        import base64
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if not (path.endswith(".json") and os.path.exists(ranks)):
            return None
        import public_tokenizers
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                 special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if self.fast and self.plain(word):
            ids = self.fast(" " + word)
            got = struct.pack(f"<{len(ids)}I", *ids)
        else:
            got = self.encode(" " + word)
        if len(self) < MEMO_ENTRIES:
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        if "" in parts or "<|" in text:
            return self.encode(text)
        head = parts[0]
        parts[0] = self.encode(head)
        parts[1:] = map(self.__getitem__, parts[1:])
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)  # one for each Python worker process


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds their token ids as binary."""
    import pyarrow as pa

    code_on_workers(docs.sparkSession)
    path = path or tokenizer_path()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = struct.pack("<I", END_ID)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for b in batches:
            rows = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = code.ids(text.as_py() or "") + end
                view = memoryview(raw)
                for i, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                    part = view[4 * start:4 * (start + n)]
                    for col, v in zip(rows, (doc, i, start, n, zlib.crc32(part), bytes(part) if with_ids else None)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, PIECE_SCHEMA + ", ids binary" * with_ids)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (length, lo, hi, per, seq, at): pieces of ``length`` with rank
    in [lo, hi) go ``per`` to a sequence from ``seq`` on, from offset ``at``.

    ``gaps[g]`` lists the open sequences with g free places as intervals.
    Every class adds at most three intervals, so all stays within a multiple
    of ``capacity``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    plan, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, total = 0, counts[length]

        def fill(gap: int, first: int, n: int) -> None:
            """Put pieces into n sequences from ``first`` on, each with ``gap`` free places."""
            nonlocal rank
            per = gap // length
            take = min(total - rank, n * per)
            plan.append((length, rank, rank + take, per, first, capacity - gap))
            rank += take
            full, part = divmod(take, per)
            for seq, m, left in ((first, full, gap - per * length), (first + full, bool(part), gap - part * length),
                                 (first + full + bool(part), n - full - bool(part), gap)):
                if m and left:
                    after.setdefault(left, []).append((seq, m))

        after: dict[int, list[tuple[int, int]]] = {}
        for gap in sorted(g for g in gaps if g >= length):  # successors, smallest first
            if rank == total:
                break
            for first, n in gaps.pop(gap):
                if rank < total:
                    fill(gap, first, n)
                else:
                    after.setdefault(gap, []).append((first, n))
        if rank < total:
            n = -(-(total - rank) // (capacity // length))
            fill(capacity, opened, n)
            opened += n
        for gap, runs in after.items():
            gaps.setdefault(gap, []).extend(runs)
    return plan


def ranked(cut_pieces: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Pieces with their ``rank`` inside their length class, and the class counts."""
    spark = cut_pieces.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cut_pieces.count() // bucket_rows))
    dealt = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    per_group = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = written(per_group.withColumn("_first", F.sum("_n").over(run) - F.col("_n")), "ranks")
    counts = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
              first.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    out = (dealt.withColumn("_at", F.row_number().over(inside) - 1)
           .join(first.drop("_n"), ["length", "_bucket"])
           .withColumn("rank", F.col("_first") + F.col("_at")).drop("_bucket", "_first", "_at"))
    return out, counts


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset`` (and their ids)."""
    cut_pieces = written(pieces(docs, path, capacity, with_ids), "pieces")
    rows, counts = ranked(cut_pieces)
    plan = docs.sparkSession.createDataFrame(sweep(counts, capacity), PLAN_SCHEMA)
    # Bounded by capacity, not by the corpus.
    placed = rows.join(F.broadcast(plan.withColumnRenamed("length", "_l")),
                       (F.col("length") == F.col("_l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    i = F.col("rank") - F.col("lo")
    return placed.select(*cut_pieces.columns,
                         (F.col("seq") + F.floor(i / F.col("per"))).cast("long").alias("sequence_id"),
                         (F.col("at") + (i % F.col("per")) * F.col("length")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences of a result with ids; at most
    ``capacity`` tokens each."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("s")).select(
        "sequence_id", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


