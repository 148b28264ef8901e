"""Exact top-k search by pivot-table elimination.

Vectors are integer (each component x becomes floor(SCALE * x)); the score is
the inner product.  The pivot table holds every vector's Euclidean distances
to PIVOTS pivots.  For a query q and a row x, |d(q, p) - d(x, p)| is a lower
bound of d(q, x) for each pivot p, and the largest of them gives an upper
bound of the score, (|q|^2 + |x|^2 - bound^2) / 2.  Rows are evaluated in
order of that bound until the k-th best score found exceeds the next bound:
the stop is exact.

Pivots are spread over a bounded sample (SAMPLE rows by hash, farthest point
first); every row is indexed and every result is exact whatever the pivots.
The sample's scores also give each query a first threshold.  Rows are grouped
into cells by nearest pivot, cells are cut into blocks of about BLOCK rows,
and a query visits only the blocks whose cell bound reaches its threshold.
Queries are dealt to chunks by their own cell, so those of a chunk ask for the
same blocks, and a block goes only to the chunks that ask for it.  Queries and
rows meet in (block, query chunk) groups of bounded size, each group returns at
most k rows per query, and those are merged.

Scores are exact whole numbers; one beyond the range of a long counts as the
nearest long.  A component whose product with SCALE is not finite counts as
non-finite.

Defined cases: vectors that are null, hold null or non-finite components,
or have a null vec_id take no part; a shorter vector counts as padded with
zeros; rows that repeat a vec_id count once, with their best score, and a
query with several vectors uses the smallest of them; with fewer than k
candidates all are returned; ties go to the smaller vec_id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm.common import code_on_workers, written
from perfweave.llm.vectors import distances, exact_scores, look_up, matrix, pack, whole_numbers, width_and_unit

SCALE = 1024
K = 10
QUERY_EVERY = 100
PIVOTS = 48
SAMPLE = 4096
BLOCK, CHUNK = 8192, 2048  # rows of a block, queries of a chunk


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows that take part."""
    sound, whole = whole_numbers(F.col("embedding"), scale)
    return rows.where(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-point pivots of a sample."""
    if not len(x):
        return x
    picked = [0]
    near = distances(x, x[:1])[:, 0]
    while len(picked) < min(n, len(x)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def upper_bounds(dq: np.ndarray, dx: np.ndarray, qq: float, xx: np.ndarray) -> np.ndarray:
    """Upper bounds of one query's scores; a margin covers rounding."""
    low = np.abs(dx - dq).max(1) if dx.shape[1] else np.zeros(len(xx))
    low = np.maximum(low * (1 - 1e-9) - 1e-6, 0.0)
    return (qq + xx - low * low) * 0.5 + 1e-9 * (qq + xx) + 1e-6


def best_of_block(q_id: int, q: np.ndarray, dq: np.ndarray, floor: float, ids: np.ndarray, x: np.ndarray,
                  dx: np.ndarray, xx: np.ndarray, k: int, unit: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a query's k best rows of a block that reach ``floor``.

    Rows come in bound order, in steps that double; the walk ends when the
    next bound is below the k-th best score (or the floor).  Distances, ``xx``
    and bounds are in the unit, scores and ``floor`` are not.
    """
    u = q / unit
    bound = upper_bounds(dq, dx, float(u @ u), xx) * unit * unit
    order = np.flatnonzero((bound >= floor) & (ids != q_id))
    order = order[np.argsort(-bound[order], kind="stable")]
    got_i, got_s = np.empty(0, np.int64), np.empty(0, np.int64)
    at, step = 0, 4 * k
    while at < len(order) and bound[order[at]] >= floor:
        part = order[at:at + step]
        got_i = np.concatenate([got_i, ids[part]])
        got_s = np.concatenate([got_s, exact_scores(q[None], x[part])[0]])
        best = np.lexsort((got_i, ~got_s))  # ~s orders like -s and cannot overflow
        got_i, got_s = got_i[best], got_s[best]
        _, first = np.unique(got_i, return_index=True)  # a vec_id counts once, with its best score
        keep = np.sort(first)[:k]
        got_i, got_s = got_i[keep], got_s[keep]
        if len(got_s) == k:
            floor = max(floor, below(got_s[-1]))
        at, step = at + len(part), 2 * step
    return got_i, got_s


def below(score) -> float:
    """A double that is not above a whole score."""
    return float(score) - 1e-9 * abs(float(score))


def top_k(rows: DataFrame, k: int = K, query_every: int = QUERY_EVERY, pivots: int = PIVOTS, sample: int = SAMPLE,
          block: int = BLOCK, chunk: int = CHUNK, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query."""
    import pandas as pd
    import pyarrow as pa

    spark = rows.sparkSession
    code_on_workers(spark)
    vectors = integer_vectors(rows, scale)
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()  # bounded sample
    width, unit = width_and_unit(vectors)
    sample_x = matrix([r["v"] for r in few], width)
    sample_ids = np.array([r["vec_id"] for r in few], np.int64)
    p = choose_pivots(sample_x / unit, pivots)
    shared = spark.sparkContext.broadcast((p, sample_x, sample_ids))  # at most ``sample`` vectors

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, _, _ = shared.value
        for b in batches:
            v = b.column(1).to_pylist()
            d = distances(matrix(v, width) / unit, p)
            cell = d.argmin(1) if d.shape[1] else np.zeros(len(v), int)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(list(d), pa.list_(pa.float64()))],
                names=["vec_id", "v", "cell", "d"])

    table = written(vectors.mapInArrow(index, "vec_id long, v array<double>, cell int, d array<double>"), "pivots")
    # Extent of every cell: rows, largest squared length, range of the distance to each pivot.
    asks = F.pmod("vec_id", F.lit(query_every)) == 0
    extent = table.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x / unit * (x / unit))).alias("xx"), F.count_if(asks).alias("q"),
        *[f(F.get("d", F.lit(i))).alias(f"{name}{i}") for i in range(len(p)) for name, f in (("lo", F.min), ("hi", F.max))]
    ).orderBy("cell").collect()  # at most ``pivots`` rows
    cells = [r["cell"] for r in extent]
    n_blocks = {r["cell"]: -(-r["n"] // block) for r in extent}
    xx = np.array([float(r["xx"]) for r in extent])
    lo, hi = (np.array([[r[f"{name}{i}"] for i in range(len(p))] for r in extent]).reshape(len(cells), len(p))
              for name in ("lo", "hi"))
    queries = table.where(asks).groupBy("vec_id").agg(F.min(F.struct("v", "d", "cell")).alias("x")).select("vec_id", "x.v", "x.d", "x.cell")
    chunk_of, chunk_cuts = pack({r["cell"]: r["q"] for r in extent}, chunk)
    own = (look_up(chunk_of, F.col("cell")) + F.pmod(F.xxhash64("vec_id", F.lit("chunk")), look_up(chunk_cuts, F.col("cell")))).cast("long")
    queries = queries.select("vec_id", "v", "d", own.alias("chunk"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each query must see, and its first threshold."""
        _, sx, s_ids = shared.value
        distinct = len(set(s_ids)) == len(s_ids)
        for b in batches:
            ids = b.column(0).to_numpy()
            q = matrix(b.column(1).to_pylist(), width)
            d = matrix(b.column(2).to_pylist(), len(p))
            out = []
            for i, (q_id, x, dq) in enumerate(zip(ids, q, d)):
                score = np.sort(exact_scores(x[None], sx[s_ids != q_id])[0])
                # Distinct ids only: the sample may repeat a vec_id.
                floor = below(score[-k]) if len(score) >= k and distinct else -np.inf
                gap = np.maximum(np.maximum(lo - dq, dq - hi), 0.0).max(1, initial=0.0) * (1 - 1e-9)
                qq = float(x / unit @ (x / unit))
                bound = (qq + xx - np.maximum(gap - 1e-6, 0.0) ** 2) * 0.5 + 1e-9 * (qq + xx) + 1e-6
                for c in np.flatnonzero(bound * unit * unit >= floor):
                    for s in range(n_blocks[cells[c]]):
                        out.append((i, cells[c], s, floor))
            at = [o[0] for o in out]
            yield pa.RecordBatch.from_arrays(
                [b.column(j).take(pa.array(at, pa.int64())) for j in range(4)]
                + [pa.array([o[j] for o in out], kind) for j, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.float64()))],
                names=["vec_id", "v", "d", "chunk", "cell", "salt", "floor"])

    asked = written(queries.mapInArrow(
        visit, "vec_id long, v array<double>, d array<double>, chunk long, cell int, salt int, floor double"), "asked")
    salt = F.pmod(F.xxhash64("vec_id"), look_up(n_blocks, F.col("cell"))).cast("int")
    blocks = table.withColumn("salt", salt).join(asked.select("cell", "salt", "chunk").distinct(), ["cell", "salt"]).select(
        "vec_id", "v", "d", *[F.col(c).alias(f"x_{c}") for c in ("cell", "salt", "chunk")])

    def search(key, x, q):
        rows = []
        if len(x) and len(q):
            ids, xs, dx = x["vec_id"].to_numpy(), matrix(x["v"], width), matrix(x["d"], len(p))
            norm = ((xs / unit) ** 2).sum(1)
            for q_id, v, d, floor in zip(q["vec_id"], matrix(q["v"], width), matrix(q["d"], len(p)), q["floor"]):
                got, score = best_of_block(q_id, v, d, floor, ids, xs, dx, norm, k, unit)
                rows += [(q_id, i, int(s)) for i, s in zip(got, score)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    by = ["cell", "salt", "chunk"]
    found = blocks.groupBy(*[f"x_{c}" for c in by]).cogroup(asked.groupBy(*by)).applyInPandas(
        search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
