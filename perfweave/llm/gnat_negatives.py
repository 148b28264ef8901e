"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

A node of the tree has up to FANOUT split points; a vector goes down to the
nearest of them.  For every split point i and every sibling subtree j the
node stores the range of the distances from i to ALL vectors of j, and the
range of their lengths.  A query knows which scores it still wants: a window
[low, high] of inner products.  With the lengths of a subtree the window is
an annulus of distances around the query; by the triangle inequality the
subtree's distances to the query lie within [max_i gap, min_i sum] of its
ranges, and a subtree whose interval misses the annulus is eliminated.
What remains are leaves, which are evaluated exactly.

The split points come from a bounded sample (SAMPLE rows by hash, farthest
points first).  Every row is indexed, the ranges cover every row, and the
result is exact whatever the split points.  Two searches share the index: the
positives of an anchor are its best rows of the same label (window from the
k-th best of the sample upwards); the negatives of each (anchor, positive)
are the best rows of other labels in [MARGIN % of the positive's score, the
positive's score].  Both raise a window's lower end as they find rows.

Leaves that follow each other in the tree are gathered in blocks of about
BLOCK rows, large leaves are cut into several; anchors are dealt to chunks of
at most about CHUNK in leaf order, so that those of a chunk ask for the same
blocks.  A block goes only to the chunks that ask for it.

Integers: a component x becomes floor(SCALE * x).  Scores are exact: as
doubles where the lengths prove every partial sum below 2**53, else as whole
numbers of any size; a score beyond the range of a long counts as the
nearest long.

Defined cases: rows with a null vec_id, label or vector, or a null or
non-finite component, or one whose product with SCALE is not finite, take no
part; shorter vectors count as padded with zeros; of rows that repeat a
vec_id the one with the least (label, vector) counts; ties go to the smaller
vec_id; a negative score has no window (80 % of it is above it), so its
positive has no negatives; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm.common import code_on_workers, written
from perfweave.llm.vectors import LONG_MAX, LONG_MIN, distances, exact_scores, look_up, matrix, pack, whole_numbers, width_and_unit

SCALE = 256
EVERY = 100       # anchors: vec_id divisible by it
NOISY = 7         # vec_id divisible by it: the label moves on by one of LABELS
LABELS = 10
POSITIVES = NEGATIVES = 5
MARGIN = 80
FANOUT, SAMPLE, LEAF = 12, 4096, 48  # split points of a node, sampled rows, sampled rows of a leaf
BLOCK, CHUNK = 2048, 1024  # rows of a block, anchors of a chunk
SLICE = 256  # anchors evaluated at once inside a task


def noisy_label(vec_id, label):
    """The label with the planted noise of the registered query."""
    return F.when(vec_id % F.lit(NOISY) == 0, (label + 1) % F.lit(LABELS)).otherwise(label)


def plain_label(vec_id, label):
    return label


def integer_rows(rows: DataFrame, scale: int, label) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v holds whole numbers as doubles."""
    sound, whole = whole_numbers(F.col("embedding"), scale)
    sound = sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    taken = rows.where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), label(F.col("vec_id").cast("long"), F.col("label").cast("long")).alias("label"),
        whole.alias("v"))
    return taken.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")


def split_points(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-point split points among the distinct vectors of a sample."""
    picked = [0]
    near = distances(x, x[:1])[:, 0]
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[picked[-1:]])[:, 0])
    return x[picked]


def build(x: np.ndarray, fanout: int, leaf: int) -> list[dict]:
    """Nodes in depth-first order: split points and, per child, a node (>= 0) or a leaf (-1 - leaf).
    Leaves are numbered in the same order."""
    nodes: list[dict] = []
    n_leaves = 0

    def grow(part: np.ndarray) -> int:
        nonlocal n_leaves
        points = split_points(part, fanout) if len(part) > leaf else part[:0]
        if len(points) < 2:
            n_leaves += 1
            return -n_leaves
        at = len(nodes)
        nodes.append({"points": points, "child": [0] * len(points)})
        side = distances(part, points).argmin(1)
        for j in range(len(points)):
            nodes[at]["child"][j] = grow(part[side == j])
        return at

    if len(x):
        grow(x)
    return nodes


def descend(nodes: list[dict], x: np.ndarray):
    """Leaf of every vector and, per node, the (rows, distances, side) of those that pass it."""
    leaf = np.zeros(len(x), np.int64)
    seen = []
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        d = distances(x[rows], nodes[at]["points"])
        side = d.argmin(1)
        seen.append((at, rows, d, side))
        for j, child in enumerate(nodes[at]["child"]):
            mine = rows[side == j]
            if child < 0:
                leaf[mine] = -1 - child
            else:
                todo.append((child, mine))
    return leaf, seen


def annulus(qq: float, lo2: float, hi2: float, low: float, high: float) -> tuple[float, float]:
    """Least and greatest distance to a query of squared length ``qq`` at which vectors of
    squared length in [lo2, hi2] can score in [low, high]; empty if the first is greater."""
    slack = 1e-9 * (qq + hi2)
    near2, far2 = qq + lo2 - 2.0 * high - slack, qq + hi2 - 2.0 * low + slack
    if not far2 >= 0:
        return (np.inf, -np.inf) if far2 < 0 else (0.0, np.inf)
    return (float(np.sqrt(max(near2, 0.0))) if np.isfinite(near2) else 0.0), float(np.sqrt(far2))


def leaves_to_visit(nodes: list[dict], extent: dict, q: np.ndarray, windows: list[tuple[float, float]]) -> list[int]:
    """Leaves that no range can eliminate for a query with these windows."""
    if not windows:
        return []
    if not nodes:
        return [0]
    qq, out, todo = float(q @ q), [], [0]
    while todo:
        at = todo.pop()
        d = distances(q[None], nodes[at]["points"])[0]
        for j, child in enumerate(nodes[at]["child"]):
            e = extent.get((at, j))
            if e is None:  # no row went there
                continue
            lo, hi, lo2, hi2 = e
            least = max(0.0, float(np.maximum(d - hi, lo - d).max())) * (1 - 1e-9) - 1e-9 * float(d.max())
            most = float((d + hi).min()) * (1 + 1e-9)
            if any(least <= far and most >= near for near, far in (annulus(qq, lo2, hi2, *w) for w in windows)):
                if child < 0:
                    out.append(-1 - child)
                else:
                    todo.append(child)
    return sorted(out)


def _head(frame: dict, k: int) -> dict:
    """The first k rows of every (anchor, slot), by score, then vec_id."""
    order = np.lexsort((frame["vec_id"], ~frame["score"], frame["slot"], frame["anchor"]))  # ~x orders like -x and cannot overflow
    a, s = frame["anchor"][order], frame["slot"][order]
    start = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])] if len(a) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
    keep = order[np.arange(len(a)) - first < k]
    return {c: v[keep] for c, v in frame.items()}


def best_in_windows(q_ids, q_labels, q, low, high, visits, ids, labels, x, leaf, same: bool, k: int) -> dict:
    """The k best rows of a block for every (anchor, slot): label equal (``same``) or different and
    score within [low, high] of that slot.  ``visits``: leaves of each anchor."""
    best = {c: np.zeros(0, np.int64) for c in ("anchor", "slot", "vec_id", "score")}
    low = low.copy()
    for u in np.unique(leaf):
        xs = np.flatnonzero(leaf == u)
        asks = np.array([i for i, v in enumerate(visits) if u in v], np.int64)
        for at in range(0, len(asks), SLICE):
            qs = asks[at:at + SLICE]
            s = exact_scores(q[qs], x[xs])
            fits = (q_labels[qs][:, None] == labels[xs][None, :]) == same
            fits &= q_ids[qs][:, None] != ids[xs][None, :]
            new = []
            for slot in range(low.shape[1]):
                a, b = np.nonzero(fits & (s >= low[qs, slot][:, None]) & (s <= high[qs, slot][:, None]))
                if len(a):
                    new.append(_head({"anchor": qs[a], "slot": np.full(len(a), slot), "vec_id": ids[xs[b]], "score": s[a, b]}, k))
            if not new:
                continue
            best = _head({c: np.concatenate([best[c], *(x[c] for x in new)]) for c in best}, k)
            # A full slot wants nothing below its k-th score any more.
            n = len(best["anchor"])
            if n >= k:
                full = np.flatnonzero((best["anchor"][k - 1:] == best["anchor"][:n - k + 1]) & (best["slot"][k - 1:] == best["slot"][:n - k + 1]))
                end = full + k - 1
                np.maximum.at(low, (best["anchor"][end], best["slot"][end]), best["score"][end])
    return best


class Index:
    """The tree over all rows of a table, and the searches in it."""

    def __init__(self, rows: DataFrame, every: int, fanout: int = FANOUT, sample: int = SAMPLE, leaf: int = LEAF,
                 block: int = BLOCK, chunk: int = CHUNK):
        """``rows``: (vec_id, label, v), one row a vec_id."""
        import pyarrow as pa

        self.every, self.chunk = every, chunk
        spark = rows.sparkSession
        rows = written(rows, "vectors")
        few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # bounded sample
        self.width, self.unit = width, unit = width_and_unit(rows)
        self.sample = (np.array([r["vec_id"] for r in few], np.int64), np.array([r["label"] for r in few], np.int64),
                       matrix([r["v"] for r in few], width))
        self.nodes = nodes = build(self.sample[2] / unit, fanout, leaf)
        tree = spark.sparkContext.broadcast(nodes)  # at most ``sample`` vectors

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, _ = descend(tree.value, matrix(b.column(2).to_pylist(), width) / unit)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["vec_id", "label", "v", "leaf"])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Ranges of what this task has seen: at most a row a child of the tree."""
            got: dict = {}
            for b in batches:
                x = matrix(b.column(2).to_pylist(), width) / unit
                xx = np.einsum("ij,ij->i", x, x)
                for at, mine, d, side in descend(tree.value, x)[1]:
                    for j in np.unique(side):
                        m = side == j
                        new = (d[m].min(0), d[m].max(0), xx[mine[m]].min(), xx[mine[m]].max())
                        old = got.get((at, j))
                        got[at, j] = new if old is None else (np.minimum(old[0], new[0]), np.maximum(old[1], new[1]),
                                                              min(old[2], new[2]), max(old[3], new[3]))
            rows = [(at, int(j), i, float(lo[i]), float(hi[i]), float(lo2), float(hi2))
                    for (at, j), (lo, hi, lo2, hi2) in got.items() for i in range(len(lo))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                [pa.int32()] * 3 + [pa.float64()] * 4)], names=["node", "child", "point", "lo", "hi", "lo2", "hi2"])

        self.rows = written(rows.mapInArrow(assign, "vec_id long, label long, v array<double>, leaf long"), "leaves")
        found = rows.mapInArrow(ranges, "node int, child int, point int, lo double, hi double, lo2 double, hi2 double").groupBy(
            "node", "child", "point").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("lo2").alias("lo2"), F.max("hi2").alias("hi2"))
        self.extent: dict = {}
        for r in found.orderBy("node", "child", "point").collect():  # nodes x FANOUT x FANOUT rows, a figure of the sample
            lo, hi, _, _ = self.extent.setdefault((r["node"], r["child"]), ([], [], r["lo2"], r["hi2"]))
            lo.append(r["lo"])
            hi.append(r["hi"])
        self.extent = {k: (np.array(a), np.array(b), c, d) for k, (a, b, c, d) in self.extent.items()}
        # Blocks of neighbouring leaves, cuts of large ones; chunks of anchors likewise.
        anchor = F.pmod("vec_id", F.lit(every)) == 0
        size = {r["leaf"]: r for r in self.rows.groupBy("leaf").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("q")).collect()}  # at most a row a leaf
        self.block_of, self.cuts = pack({u: r["n"] for u, r in size.items()}, block)
        self.chunk_of, self.chunk_cuts = pack({u: r["q"] for u, r in size.items()}, chunk)
        self.tree = spark.sparkContext.broadcast((nodes, self.extent, self.sample, self.block_of, self.cuts))

    def anchors(self) -> DataFrame:
        """(vec_id, label, v, chunk) of the anchors."""
        cut = F.pmod(F.xxhash64("vec_id", F.lit("chunk")), look_up(self.chunk_cuts, F.col("leaf")))
        return self.rows.where(F.pmod("vec_id", F.lit(self.every)) == 0).select(
            "vec_id", "label", "v", (look_up(self.chunk_of, F.col("leaf")) + cut).cast("long").alias("chunk"))

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, slot, vec_id, score): the k best rows of every (anchor, window).

        ``asked``: the columns of ``anchors`` and ``low``, ``high``, arrays of longs with one window a slot.
        """
        import pandas as pd
        import pyarrow as pa

        width, unit, shared = self.width, self.unit, self.tree

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, extent, (s_ids, s_labels, sx), block_of, cuts = shared.value
            for b in batches:
                rows = b.to_pylist()
                q = matrix([r["v"] for r in rows], width)
                out = []
                for at in range(0, len(rows), SLICE):
                    scores = exact_scores(q[at:at + SLICE], sx)
                    for i, r in enumerate(rows[at:at + SLICE]):
                        fits = ((s_labels == r["label"]) == same) & (s_ids != r["vec_id"])
                        low = []
                        for lo, hi in zip(r["low"], r["high"]):
                            # k sampled rows inside a window raise its lower end.
                            inside = np.sort(scores[i][fits & (scores[i] >= lo) & (scores[i] <= hi)])
                            low.append(max(lo, int(inside[-k])) if len(inside) >= k else lo)
                        # A window end at the range of a long stands for everything beyond.
                        reach = [(-np.inf if lo <= LONG_MIN else lo / unit / unit, np.inf if hi >= LONG_MAX else hi / unit / unit)
                                 for lo, hi in zip(low, r["high"]) if lo <= hi]
                        in_block: dict = {}  # leaves of every block to visit
                        for u in leaves_to_visit(nodes, extent, q[at + i] / unit, reach):
                            for cut in range(cuts.get(u, 0)):
                                in_block.setdefault(block_of[u] + cut, []).append(u)
                        out += [(at + i, block, leaves, low) for block, leaves in in_block.items()]
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(n).take(at) for n in ("vec_id", "label", "v", "chunk", "high")]
                    + [pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64())),
                       pa.array([o[3] for o in out], pa.list_(pa.int64()))],
                    names=["vec_id", "label", "v", "chunk", "high", "block", "leaves", "low"])

        leaf = F.col("leaf")
        visits = written(asked.select("vec_id", "label", "v", "chunk", "high", "low").mapInArrow(
            visit, "vec_id long, label long, v array<double>, chunk long, high array<long>, block long, leaves array<long>, low array<long>"), "visits")
        cut = F.pmod(F.xxhash64("vec_id"), look_up(self.cuts, leaf))
        blocks = self.rows.withColumn("block", (look_up(self.block_of, leaf) + cut).cast("long")).join(
            visits.select("block", "chunk").distinct(), "block").select(
            "vec_id", "label", "v", "leaf", F.col("block").alias("x_block"), F.col("chunk").alias("x_chunk"))

        def run(key, x, q):
            if not len(x) or not len(q):
                return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("anchor_id", "slot", "vec_id", "score")})
            q_ids = q["vec_id"].to_numpy()
            # An anchor with fewer windows than others gets empty ones.
            slots = max(map(len, q["low"]))
            low, high = (np.array([[*v, *[empty] * (slots - len(v))] for v in q[c]], np.int64).reshape(len(q), slots)
                         for c, empty in (("low", LONG_MAX), ("high", LONG_MIN)))
            got = best_in_windows(q_ids, q["label"].to_numpy(), matrix(q["v"], width), low, high, [set(v) for v in q["leaves"]],
                                  x["vec_id"].to_numpy(), x["label"].to_numpy(), matrix(x["v"], width), x["leaf"].to_numpy(), same, k)
            return pd.DataFrame({"anchor_id": q_ids[got["anchor"]], "slot": got["slot"], "vec_id": got["vec_id"], "score": got["score"]})

        found = blocks.groupBy("x_block", "x_chunk").cogroup(visits.groupBy("block", "chunk")).applyInPandas(
            run, "anchor_id long, slot long, vec_id long, score long")
        best = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def positives(index: Index, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_id, order, positive_score): the k best other rows of the anchor's label."""
    everything = F.array(F.lit(LONG_MIN).cast("long")), F.array(F.lit(LONG_MAX).cast("long"))
    asked = index.anchors().withColumns({"low": everything[0], "high": everything[1]})
    return index.search(asked, True, k).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("order"), F.col("score").alias("positive_score"))


def mine(rows: DataFrame, k_positives: int = POSITIVES, k: int = NEGATIVES, margin: int = MARGIN, every: int = EVERY,
         scale: int = SCALE, label=plain_label, **tree) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    code_on_workers(rows.sparkSession)
    index = Index(integer_rows(rows, scale, label), every, **tree)
    pos = written(positives(index, k_positives), "positives")
    # Lower end: the least whole score with 100 * score >= margin * positive_score, in numbers of any size.
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * F.lit(margin) / F.lit(100)).cast("long")
    windows = pos.withColumn("low", low).groupBy("anchor_id").agg(F.sort_array(F.collect_list(
        F.struct("order", "positive_id", "positive_score", "low"))).alias("w"))  # at most k_positives
    asked = index.anchors().join(windows, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", "chunk", F.col("w.low").alias("low"), F.col("w.positive_score").alias("high"))
    found = index.search(asked, False, k)
    return found.join(windows, "anchor_id").withColumn("w", F.get("w", F.col("slot").cast("int"))).select(
        "anchor_id", F.col("w.positive_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("w.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE = r"""
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, vec_id) <= 5
"""
