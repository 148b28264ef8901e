"""Near-duplicate components by an n-gram Jaccard join with adaptive prefixes.

A document is its set of distinct SHINGLE-word shingles (64-bit hashes).  Two
documents link when 100 * intersection >= PERCENT * union.  All shingles have
one global order: class of estimated document frequency first, hash second;
an order key holds both.  Linked
sets x, y share at least ceil(t * max(|x|, |y|)) shingles, t = PERCENT / 100,
so for every l the first |x| - ceil(t |x|) + l shingles of x and the like of y
have l in common (multi-match prefix).  Each document picks its own l: longer
prefixes mean longer posting lists, but candidates must share more of them;
the estimated cost is (1 + VERIFY / l) times the summed frequencies of the
prefix.  A pair is a candidate only if its prefixes share min(l_x, l_y).

Frequencies come from a count sketch over all shingles of all documents
(2 ** SKETCH_BITS counters, a fixed size to broadcast).  They steer order and
cost only; collisions cannot change a result.

Equal sets are one class, represented by its smallest doc_id.  The classes
in a posting list are first compared with hubs only: lists are cut by set size
(twice, with shifted borders, so that linked sizes share a cut), and the hub of
a cut is the class with the fewest shingles of its own, that is, with the
list's shingle earliest in its order; the original of a group of near copies is
such a class.  Classes that verified links already join need no further
comparison.  Then the pairs that are still open are generated: a pair of one
list in different components, of which at most one is in the list's largest
component, and whose shingle stands early enough in both: if it is the first
common one, all before it are lost to the intersection, so |x| - position must
reach the intersection that a link needs.  A group that shares a passage but
has too many shingles of its own thus makes no pairs, and neither does a group
of thousands of near copies.  No link between components is lost.  Posting
lists that the sketch calls long are split by salt, and their hubs meet in a
second round.  Before any set is fetched, a pair's two prefixes must share
min(l_x, l_y) shingles and bound its intersection: up to the smaller of their
last keys all common shingles are seen, and beyond it at most the shorter rest
is common.  Verification counts the exact intersection of the hash sets.

Defined cases: null and blank texts have empty sets and link with nothing;
with fewer than SHINGLE words the whole sequence is one shingle; repeated rows
are one class; rows with a null doc_id get their class's component if a
row with a doc_id shares the set, else null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm import wordhash as H
from perfweave.llm.common import code_on_workers, written
from perfweave.llm.components import components

SHINGLE, PERCENT = 3, 90
SKETCH_BITS = 20
MATCHES = 8  # largest l a document may pick
VERIFY = 8.0  # cost of verifying a candidate, in posting entries
SALT_ROWS = 20_000  # estimated entries of a posting list per salt

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    if not text:
        return np.empty(0, H.U64)
    words, _, _ = H.word_hashes(text.encode("utf-8", "replace").translate(_LOWER))
    if not len(words):
        return words
    return np.unique(H.window_hashes(words, min(size, len(words))))


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any linked set: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def order_keys(h: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Sortable keys (positive 64-bit): frequency class, then 56 bits of the hash."""
    level = np.minimum(4 * np.log2(1.0 + frequency[(h >> H.U64(64 - SKETCH_BITS)).astype(np.int64)]), 127).astype(np.int64)
    return (level << 56) | (h & H.U64((1 << 56) - 1)).astype(np.int64)


def bit_words(keys: np.ndarray) -> np.ndarray:
    """256 bits, one set for each key by its hash."""
    out = np.zeros(4, H.U64)
    at = keys & 255
    np.bitwise_or.at(out, at >> 6, H.U64(1) << (at & 63).astype(H.U64))
    return out.astype(np.int64)


def choose_matches(frequency: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(l, prefix length) with the least estimated cost; ``frequency`` is in prefix order."""
    common = least_common(n, percent)
    ls = np.arange(1, min(MATCHES, common) + 1)
    entries = np.cumsum(frequency[:n - common + len(ls)], dtype=np.float64)[n - common:][:len(ls)]
    best = int(np.argmin(entries * (1.0 + VERIFY / ls)))
    return int(ls[best]), n - common + int(ls[best])


def sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Document frequency estimates by the top SKETCH_BITS of a hash."""
    import pyarrow as pa
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    cells, parts = 1 << SKETCH_BITS, 64
    per = cells // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for b in batches:
            for t in b.column(0):
                np.add.at(total, (shingle_hashes(t.as_py(), size) >> H.U64(64 - SKETCH_BITS)).astype(np.int64), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(list(total.reshape(parts, per)), pa.list_(pa.float64()))],
                                         names=["part", "n"])

    # Added up row by row in the JVM: a part's buffer is one vector, however many tasks send one.
    sums = docs.select("text").mapInArrow(count, "part int, n array<double>").groupBy("part").agg(
        vector_to_array(Summarizer.sum(array_to_vector("n"))).alias("n")).collect()  # parts rows, 8 MB in all
    out = np.zeros(cells)
    for r in sums:
        out[r["part"] * per:(r["part"] + 1) * per] = r["n"]
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


SET_SCHEMA = "doc_id long, n long, fp1 long, fp2 long, l int, prefix array<long>, salts array<int>, bits array<long>"


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document: set size, fingerprint, l, prefix and number of salts of each prefix entry."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs, size))  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        noise = frequency.mean()  # what other shingles add to a counter
        for b in batches:
            rows = []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), size)
                n = len(h)
                if not n:
                    rows.append((0, 0, 0, 0, [], [], []))
                    continue
                fp1, fp2 = (int(H.mix(h ^ H.U64(c)).sum(dtype=H.U64).astype(np.int64))
                            for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
                keys = order_keys(h, frequency)
                order = np.argsort(keys)[:n - least_common(n, percent) + MATCHES]
                f = np.maximum(frequency[(h[order] >> H.U64(64 - SKETCH_BITS)).astype(np.int64)] - noise, 1.0)
                l, length = choose_matches(f, n, percent)
                rows.append((n, fp1, fp2, l, keys[order[:length]], (1 + f[:length] // SALT_ROWS).astype(np.int32),
                             bit_words(keys[order[:length]])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                names=["doc_id", "n", "fp1", "fp2", "l", "prefix", "salts", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SET_SCHEMA)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, items): sorted shingle hashes of the documents."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [shingle_hashes(t.as_py(), size).astype(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(pa.int64()))], names=["id", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, items array<long>")


def _sizes_fit(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _early(pos: str, n: str, percent: int) -> Column:
    """0 if the smaller set of a linked pair can have its first common shingle here, else 1: the
    other is no smaller, so the link needs 2 percent / (100 + percent) of this set."""
    fits = (F.col(n) - F.col(pos)) * (100 + percent) >= F.col(n) * (2 * percent)
    return F.when(fits, 0).otherwise(1)


def _bits_fit(a: str, b: str, percent: int) -> Column:
    """False if the prefix bits alone rule a pair out.

    The prefix that ends first lies in the part that both prefixes show.  Each
    of its bits that the other lacks is a shingle the other lacks."""
    def lacks(s, o):
        return sum((F.bit_count(F.get(f"bits{s}", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"bits{o}", F.lit(i)))))
                    for i in range(4)), F.lit(0))

    room = [(F.col(f"n{s}") - lacks(s, o)) * (100 + percent) >= (F.col(f"n{a}") + F.col(f"n{b}")) * percent
            for s, o in ((a, b), (b, a))]
    return F.when(F.col(f"last{a}") <= F.col(f"last{b}"), room[0]).otherwise(room[1])


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their prefixes do not rule out."""
    of = classes.select("id", "n", F.col("x.l").alias("l"), F.col("x.prefix").alias("p"))
    both = (pairs.select("a", "b").join(of.select(*[F.col(c).alias(f"{c}b") for c in ("id", "n", "l", "p")]), F.col("b") == F.col("idb"))
            .join(of.select(*[F.col(c).alias(f"{c}a") for c in ("id", "n", "l", "p")]), F.col("a") == F.col("ida")))
    common = F.size(F.array_intersect("pa", "pb"))
    seen = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
    rest = F.least(*[F.col(f"n{s}") - F.size(F.filter(f"p{s}", lambda x: x <= F.col("seen"))) for s in "ab"])
    return (both.withColumns({"seen": seen, "common": common})
            .where((F.col("common") >= F.least("la", "lb"))
                   & ((F.col("common") + rest) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent))
            .select("a", "b"))


def verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    with_b = pairs.select("a", "b").join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    both = with_b.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b").distinct()


def sets_of(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Sets of the documents that take part in pairs, written."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # The same plan at every size: both sides are shuffled by doc_id.
    texts = docs.join(wanted.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return written(sets(texts, size), "sets")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (equal sets), component_id."""
    code_on_workers(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(prefixes(narrow, size, percent), "prefixes")
    classes = written(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2", "n").agg(
        F.min("doc_id").alias("id"), F.min_by(F.struct("l", "prefix", "salts", "bits"), "doc_id").alias("x")), "classes")

    # Posting entries with their position and the salt that splits lists the sketch calls long.
    entry = F.posexplode(F.arrays_zip(F.col("x.prefix").alias("t"), F.col("x.salts").alias("s"))).alias("pos", "e")
    postings = classes.select("id", "n", F.col("x.l").alias("l"), entry).select(
        "id", "n", "l", "pos", F.col("e.t").alias("t"), F.col("e.s").alias("salts"),
        F.pmod(F.xxhash64("id"), F.col("e.s")).cast("int").alias("salt"))
    # Linked sizes differ by a factor of 100 / percent at most: two cuts of twice that width, half a width apart.
    scale = F.log("n") / F.lit(2.0 * np.log(100.0 / percent)) if percent < 100 else F.col("n").cast("double")
    me = F.struct((F.col("pos") / F.col("n")).alias("own"), "id", "n")
    cut = [F.floor(scale + F.lit(shift)).alias(f"cut{i}") for i, shift in enumerate((0.0, 0.5))]
    lists = postings.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("t", "salt"))).where("k > 1 OR salts > 1").drop("k").select("*", *cut)
    for i in range(2):
        lists = lists.withColumn(f"hub{i}", F.min(me).over(Window.partitionBy("t", "salt", f"cut{i}")))
    lists = written(lists, "lists")
    both = lists.select("t", "salt", "salts", "id", "n", F.inline(F.array(*[F.struct(
        F.lit(i).alias("layout"), F.col(f"cut{i}").alias("cut"), F.col(f"hub{i}").alias("hub")) for i in range(2)])))
    first = both.select(F.col("hub.id").alias("a"), F.col("hub.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))
    hubs = both.where("salts > 1").groupBy("t", "layout", "cut", "salt").agg(F.min("hub").alias("h")).groupBy("t", "layout", "cut").agg(
        F.min("h").alias("top"), F.collect_set("h").alias("all"))  # as many as salts
    second = hubs.select("top", F.explode("all").alias("h")).select(
        F.col("top.id").alias("a"), F.col("top.n").alias("na"), F.col("h.id").alias("b"), F.col("h.n").alias("nb"))
    star = first.unionByName(second).where(
        (F.col("a") != F.col("b")) & _sizes_fit(F.col("na"), F.col("nb"), percent)).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = written(plausible(star, classes, percent), "star")
    links = written(verified(star, sets_of(narrow, star, size), percent), "links")
    joined = written(components(links), "components")

    # What the stars left open: lists that hold more than one component.
    about = classes.select("id", "x.bits", F.element_at("x.prefix", -1).alias("last")).join(
        joined.select(F.col("node").alias("id"), "component"), "id", "left")
    at = written(lists.select("t", "id", "n", "pos").join(about, "id").select(
        "t", "id", "n", "pos", "last", "bits", F.coalesce("component", "id").alias("c")), "members")
    sizes = at.groupBy("t", "c").agg(F.count(F.lit(1)).alias("k"), F.min(_early("pos", "n", percent)).alias("late"))
    mixed = sizes.groupBy("t").agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("cs"), F.min("late").alias("late")).where(
        "cs > 1 AND late = 0").select("t", F.col("m.c").alias("largest"))
    rest = written(at.join(mixed, "t"), "open-lists")
    x, y = (rest.select("t", "largest", *[F.col(c).alias(f"{c}{s}") for c in ("id", "n", "pos", "last", "bits", "c")]) for s in ("1", "2"))
    outside = x.where("c1 <> largest").drop("largest")
    reach = [(F.col(f"n{s}") - F.col(f"pos{s}")) * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent for s in "12"]
    open_pairs = outside.join(y, (outside["t"] == y["t"]) & (F.col("c1") != F.col("c2")) & reach[0] & reach[1] & _bits_fit("1", "2", percent)).select(
        F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
    fresh = written(plausible(open_pairs.join(star, ["a", "b"], "left_anti"), classes, percent), "open-pairs")
    more = written(verified(fresh, sets_of(narrow, fresh, size), percent), "more")
    joined = written(components(links.unionByName(more)), "components")

    placed = classes.select("fp1", "fp2", F.col("n").alias("_n"), "id").join(
        joined.select(F.col("node").alias("id"), "component"), "id", "left").select(
        F.col("fp1").alias("_1"), F.col("fp2").alias("_2"), "_n", F.col("id").alias("class_id"),
        F.coalesce("component", "id").alias("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "fp1", "fp2").join(
        placed, (F.col("fp1") == F.col("_1")) & (F.col("fp2") == F.col("_2")) & (F.col("n_shingles") == F.col("_n")),
        "left").select("doc_id", "n_shingles", F.coalesce("class_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("class_id"),
                       F.coalesce("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without near-duplicates, with all columns: of each component
    the smallest doc_id stays.  Documents without a set, rows without doc_id
    and rows that repeat a kept doc_id stay."""
    judged = near_duplicates(docs, size, percent)
    gone = judged.where(F.col("doc_id").isNotNull() & (F.col("component_id") != F.col("doc_id"))).select(
        F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
