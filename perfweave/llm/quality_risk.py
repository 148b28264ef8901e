"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Per-text measures are plain column expressions.  A rule rejects a document
when one measure exceeds a cutoff.  Cutoffs are chosen per stratum (a column,
language by default) from labelled holdout documents: for each rule and each
candidate cutoff, n good documents of the stratum are counted and k of them
would be rejected; the cutoff is admissible when the exact binomial tail
P[Bin(n, alpha_rule) <= k] is at most delta / (number of tests), i.e. when
the Clopper-Pearson upper bound of the false rejection rate is at most
``alpha_rule``.  Bonferroni over strata x rules x cutoffs, and
``alpha_rule = alpha / rules``, so with probability 1 - delta no stratum loses
more than ``alpha`` of its good documents to all rules together.  The
strictest admissible cutoff is used; a stratum in which no cutoff is
admissible (too few labels) gets none and rejects nothing by that rule.

Defined cases: a null or blank text has zero words and fails the base rule; a
null stratum is a stratum of its own; a null doc_id matches no label;
repeated documents are judged row by row; a document with several labels is
good only when all its labels say so; rows with null labels are ignored;
without labels only the base rule rejects.  Extra columns of the input pass
through ``filter_documents`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import let, words, written
from perfweave.operators.joins import bounded_broadcast

# Base rule of the contract: fixed values.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

# Candidate cutoffs of every measure, a geometric ladder in (0, 1].
LADDER = tuple(round(0.005 * 1.15 ** i, 6) for i in range(38))

# Measures in [0, 1]; larger is worse.
RULES = ("r_symbols", "r_dup_lines", "r_repeat", "r_shout", "r_nonword")

_INDEX_BITS = 24  # words of one text: 16.7 million


def _repeat_words(hashes: Column, ws: Column) -> Column:
    """Words covered by REPEAT_WINDOW-word windows that occur twice or more.

    Each window becomes one long, (hash << 24 | start); sorting brings equal
    hashes together.  Neighbours with equal hashes are confirmed on the words
    themselves; the starts found are sorted and their cover is summed.
    """
    k = REPEAT_WINDOW
    mask = (1 << _INDEX_BITS) - 1

    def window_key(h, i):
        return F.shiftleft(F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]), _INDEX_BITS).bitwiseOR(
            i.cast("long"))

    def start(key):
        return key.bitwiseAND(F.lit(mask).cast("long")).cast("int")

    def same(a, b):
        return (F.shiftright(a, _INDEX_BITS) == F.shiftright(b, _INDEX_BITS)) & (
            F.slice(ws, start(a) + 1, F.lit(k)) == F.slice(ws, start(b) + 1, F.lit(k)))

    keys = F.sort_array(F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(0))),
                                    window_key))

    def starts_of(keys):
        hit = F.filter(keys, lambda x, i: (F.coalesce(same(x, F.get(keys, i - 1)), F.lit(False)))
                       | (F.coalesce(same(x, F.get(keys, i + 1)), F.lit(False))))
        return F.sort_array(F.transform(hit, start))

    def cover(starts):
        return F.aggregate(
            F.transform(starts, lambda s, i: F.least(F.lit(k), F.coalesce(F.get(starts, i + 1) - s, F.lit(k)))),
            F.lit(0), lambda a, x: a + x)

    return F.when(F.size(hashes) <= k, F.lit(0)).otherwise(
        let(keys, lambda ks: let(starts_of(ks), cover)))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures as one struct column ``_m`` (every text read once)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of_words(ws):
        hashes = F.transform(ws, lambda w: F.xxhash64(w))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            let(hashes, lambda h: _repeat_words(h, ws)).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = let(words(F.col(text)), of_words)
    by_line = let(lines, lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return docs.withColumn("_m", F.struct(
        w.alias("w"), by_line.alias("l"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, r"[\p{L}\p{M}\s.,;:'\"?()-]+", "")).cast("long").alias("n_nonword")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def measured(docs: DataFrame, stratum: str, keep: list[str]) -> DataFrame:
    """Narrow table of ``keep`` columns, stratum, base figures and rule measures."""
    m = measures(docs.select(*keep, F.col(stratum).alias("_stratum"), "text"))
    c = F.col
    return m.select(
        *keep, "_stratum", c("_m.w.n_words").alias("n_words"), c("_m.w.word_chars").alias("word_chars"),
        c("_m.n_symbols").alias("n_symbols"), c("_m.l.n_dup_lines").alias("n_dup_lines"),
        c("_m.w.n_repeat_words").alias("n_repeat_words"),
        _ratio(c("_m.n_symbols"), c("_m.w.word_chars")).alias("r_symbols"),
        _ratio(c("_m.l.n_dup_lines"), c("_m.l.n_lines")).alias("r_dup_lines"),
        _ratio(c("_m.w.n_repeat_words"), c("_m.w.n_words")).alias("r_repeat"),
        _ratio(c("_m.n_upper"), c("_m.w.word_chars")).alias("r_shout"),
        _ratio(c("_m.n_nonword"), c("_m.w.word_chars")).alias("r_nonword"),
    ).withColumn("base_failed", (c("n_words") < MIN_WORDS)
                 | (F.lit(100) * c("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * c("n_words")))


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series (absolute error below 1e-9 for n >= 8, table below)."""
    small = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.6931471805599453, 1.791759469228055, 3.1780538303479458,
                                         4.787491742782046, 6.579251212010101, 8.525161361065415)])
    x = n.cast("double") + 1.0
    series = ((x - 0.5) * F.ln(x) - x + F.lit(0.9189385332046727) + F.lit(1 / 12) / x
              - F.lit(1 / 360) / (x * x * x) + F.lit(1 / 1260) / F.pow(x, F.lit(5.0)))
    return F.when(n < 8, F.get(small, n.cast("int"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P[Bin(n, p) <= k] for k below the mean n p (1.0 otherwise: no cutoff can pass there).

    Terms fall geometrically from k downwards; they are summed for 60 + 12
    sqrt(n) steps and the rest is bounded by its geometric series, so the
    value is never below the exact tail.
    """
    nd, kd = n.cast("double"), k.cast("double")
    log_top = (log_factorial(n) - log_factorial(k) - log_factorial(n - k)
               + kd * F.log(F.lit(p)) + (nd - kd) * F.log1p(F.lit(-p)))
    odds = (1 - p) / p
    steps = F.least(k, (F.lit(60.0) + 12.0 * F.sqrt(nd)).cast("long"))
    down = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, j: F.struct(
            (s["term"] * (kd - j) * odds / (nd - kd + j + 1.0)).alias("term"),
            (s["total"] + s["term"]).alias("total")))
    left = let(down, lambda s: s["total"] + F.when(
        steps < k, s["term"] / (1.0 - F.least(kd * odds / (nd - kd + 1.0), F.lit(0.999999999)))).otherwise(F.lit(0.0)))
    return F.when((n <= 0) | (kd >= nd * p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_top) * left))


def good_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per labelled document: good when all its labels are 1."""
    return (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_good")).where(F.col("_good") == 1))


def cutoffs(measured_docs: DataFrame, labels: DataFrame, key: str = "doc_id",
            alpha: float = 0.02, delta: float = 0.05, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """(_stratum, rule, cutoff): the strictest admissible cutoff of every rule."""
    good = measured_docs.where(~F.col("base_failed")).join(good_labels(labels, key), F.col(key) == F.col("_key"))
    steps = F.array(*[F.lit(c) for c in ladder])

    # One row per (stratum, rule, ladder step): partial counts before the shuffle.
    def step(c):  # index of the first cutoff that keeps the document
        return F.size(F.filter(steps, lambda x: x < c))

    long = good.select("_stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), step(F.col(r)).alias("step")) for r in RULES])).alias("x"))
    counts = long.groupBy("_stratum", "x.rule", "x.step").count()
    total = written(counts.groupBy("_stratum", "rule").agg(
        F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("by_step")),
        "holdout")  # strata x rules rows, each with at most ladder + 1 counts
    grid = total.select("_stratum", "rule", "n", F.posexplode(steps).alias("i", "cutoff"), "by_step").select(
        "_stratum", "rule", "n", "cutoff",
        F.aggregate(F.map_entries("by_step"), F.lit(0).cast("long"),
                    lambda a, e: a + F.when(e["key"] > F.col("i"), e["value"]).otherwise(F.lit(0).cast("long"))).alias("k"))
    tests = max(1, total.select("_stratum").distinct().count()) * len(RULES) * len(ladder)
    return (grid.where(binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta / tests))
            .groupBy("_stratum", "rule").agg(F.min("cutoff").alias("cutoff")))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
             alpha: float = 0.02, delta: float = 0.05, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, ``also`` columns, base figures, rule measures, ``base_failed``, ``kept``."""
    m = written(measured(docs, stratum, [key, *also]), "quality")
    cut = cutoffs(m, labels, key, alpha, delta).groupBy(F.col("_stratum").alias("_s")).pivot(
        "rule", list(RULES)).agg(F.min("cutoff"))
    cut = bounded_broadcast(written(cut.select("_s", *[F.col(r).alias(f"cut_{r}") for r in RULES]), "cutoffs"))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return (m.join(cut, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~over).drop("_s", "_stratum"))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
                     alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The documents that the rules keep, with all their columns (matched by key and text)."""
    judged = docs.select(key, stratum, "text", F.xxhash64("text").alias("_text_hash"))
    good = verdicts(judged, labels, stratum, key, alpha, delta, ("_text_hash",)).where("kept").select(
        F.col(key).alias("_kept_key"), F.col("_text_hash").alias("_kept_hash"))
    return docs.join(good, docs[key].eqNullSafe(good["_kept_key"])
                     & (F.xxhash64(docs["text"]) == good["_kept_hash"]), "left_semi")
