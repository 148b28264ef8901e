"""Secret scans by pattern and by character Markov models (DataFrame functions only).

Pattern spans of three kinds (assign, access, hex) are found in the whole
text; positions come from splitting the text at the matches and summing the
lengths of the pieces, in code points.  Further spans come from two
first-order character models: one of random strings, one of ordinary
identifiers.  A token (a run of 16 or more of ``[A-Za-z0-9+/_=-]``) that
overlaps no pattern span becomes a ``markov`` span when its log-likelihood
ratio per transition exceeds a threshold.

Both models are trained from labelled strings (text, label 1 = random,
0 = ordinary): transition counts over character classes, add-one smoothed.
``corpus_samples`` labels the corpus itself: values matched by the patterns
are random, and the other tokens of the same shape are ordinary.  The model
is a table of at most CLASSES^2 numbers, whatever the corpus.

Defined cases: null and empty texts have no spans; repeated documents are
scanned row by row; an empty corpus gives the smoothed uniform model, whose
ratio is 0, so no ``markov`` spans; other columns pass through ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfweave.llm.common import let

# Patterns of the contract: fixed values.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_VALUE_MIN = 12
# A greedy run of fewer characters never matches later in the same run, so
# the minimum length can stand inside the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

KINDS = ("assign", "access", "hex", "markov")  # order of kinds at one start

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
THRESHOLD = 0.35  # nats per transition

# Character classes: every digit, letter and sign of TOKEN is its own class.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
CLASSES = len(ALPHABET)


def _spans(text: Column, pattern: str, kind: str, value_group: int = 0, value_min: int = 0) -> Column:
    """Sorted spans (start, end, kind) of the leftmost non-overlapping matches."""
    rank = KINDS.index(kind)
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(ps, ms):
        return F.aggregate(
            F.sequence(F.lit(1), F.size(ms)),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,k:int,i:int>>").alias("out")),
            lambda a, i: let(a["at"] + F.length(F.element_at(ps, i)), lambda s: let(
                s + F.length(F.element_at(ms, i)), lambda e: F.struct(
                    e.alias("at"), F.concat(a["out"], F.array(F.struct(
                        s.alias("s"), e.alias("e"), F.lit(rank).alias("k"), i.alias("i")))).alias("out")))),
            lambda a: a["out"])

    spans = let(found, lambda ms: F.when(F.size(ms) > 0, let(pieces, lambda ps: place(ps, ms))))
    if value_min:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
        spans = let(spans, lambda sp: F.when(F.size(sp) > 0, let(values, lambda vs: F.filter(
            sp, lambda x: F.length(F.element_at(vs, x["i"])) >= value_min))))
    return F.when(text.rlike(pattern), spans)


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,k:int,i:int>>")


def pattern_spans(text: Column) -> Column:
    """All pattern spans of a text, by start, then kind as listed."""
    assign = _spans(text, ASSIGN, "assign", 2, ASSIGN_VALUE_MIN)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, "access"))
    hexes = _spans(text, HEX, "hex")
    return F.array_sort(F.concat(*[F.coalesce(x, _none()) for x in (assign, access, hexes)]),
                        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))


def _token_spans(text: Column) -> Column:
    return F.coalesce(_spans(text, TOKEN, "markov"), _none())


def _outside(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no span of ``base``."""
    return F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))


def _text_of(text: Column, span) -> Column:
    return F.substring(text, span["s"] + 1, span["e"] - span["s"])


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_base`` (pattern spans) and ``_tokens`` (other token spans with their strings)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_base", pattern_spans(t))
    return df.withColumn("_tokens", F.when(t.rlike(TOKEN), F.transform(
        let(_token_spans(t), lambda ts: _outside(ts, F.col("_base"))),
        lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), _text_of(t, s).alias("text")))))


def corpus_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled strings (text, label) of a corpus: see the module text."""
    df = scanned(docs.select(text), text)
    t = F.coalesce(F.col(text), F.lit(""))
    random = F.transform(F.col("_base"), lambda s: F.struct(
        F.regexp_extract(_text_of(t, s), r"[A-Za-z0-9+/_=-]+$", 0).alias("text"), F.lit(1).alias("label")))
    ordinary = F.transform(F.col("_tokens"), lambda s: F.struct(s["text"].alias("text"), F.lit(0).alias("label")))
    return df.select(F.explode(F.concat(
        random, F.coalesce(ordinary, F.array().cast("array<struct<text:string,label:int>>")))).alias("x")).select("x.*")


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of the CLASSES x CLASSES transitions (row-major)."""
    pairs = samples.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("label", F.explode(
        F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(F.col("text"), i, 2))).alias("p"))
    rows = pairs.where(F.length("p") == 2).groupBy("label", "p").count().collect()  # <= 2 x CLASSES^2 rows
    n = [[[1.0] * CLASSES for _ in range(CLASSES)] for _ in (0, 1)]
    for r in rows:
        a, b = ALPHABET.find(r["p"][0]), ALPHABET.find(r["p"][1])
        if a >= 0 and b >= 0 and r["label"] in (0, 1):
            n[r["label"]][a][b] += r["count"]
    total = [[sum(row) for row in m] for m in n]
    return [math.log(n[1][a][b] / total[1][a]) - math.log(n[0][a][b] / total[0][a])
            for a in range(CLASSES) for b in range(CLASSES)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    table = F.split(F.lit(" ".join(f"{v:.9g}" for v in model)), " ").cast("array<double>")
    chars = F.split(token, "")

    def mean(codes):
        return F.aggregate(
            F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0),
            lambda a, i: a + F.element_at(table, ((F.element_at(codes, i) - 1) * CLASSES
                                                  + F.element_at(codes, i + 1)).cast("int"))) / (F.size(codes) - 1)

    return let(F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c)), mean)


def find(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``_base`` and ``_spans`` (all spans, by start, then kind) to the documents."""
    df = scanned(docs, text)
    added = F.transform(
        F.filter(F.coalesce(F.col("_tokens"), F.array().cast("array<struct<s:int,e:int,text:string>>")),
                 lambda x: ratio(x["text"], model) > threshold),
        lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index("markov")).alias("k"),
                           F.lit(0).alias("i")))
    return df.withColumn("_spans", F.array_sort(
        F.concat(F.col("_base"), added),
        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]))).drop("_tokens")


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[float], text: str = "text", mask: str = "[SECRET]",
           threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every span replaced by ``mask`` (overlapping spans as one)."""
    # The input row travels as one struct, so its column names cannot clash.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("text"))
    df = find(row, model, "text", threshold)
    t = F.col("text")

    def step(a, s):  # spans come by start; ``at`` is the end of what is already handled
        gap = F.substring(t, a["at"] + 1, s["s"] - a["at"])
        return F.when(s["s"] >= a["at"], F.struct(s["e"].alias("at"), F.concat(a["out"], gap, F.lit(mask)).alias("out"))
                      ).otherwise(F.struct(F.greatest(a["at"], s["e"]).alias("at"), a["out"].alias("out")))

    clean = F.aggregate(F.col("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    return df.select(*[F.when(F.size("_spans") > 0, clean).otherwise(t).alias(c) if c == text else F.col("_row")[c].alias(c)
                       for c in docs.columns])


def digest(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of every document, with the model trained on the whole corpus."""
    model = train(corpus_samples(docs))
    df = find(docs.select("doc_id", "text"), model, threshold=threshold)

    def count(kind):
        return F.size(F.filter("_base", lambda s: s["k"] == KINDS.index(kind))).cast("long")

    return df.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"),
        F.size(F.filter("_spans", lambda s: s["k"] == KINDS.index("markov"))).cast("long").alias("n_markov"))
