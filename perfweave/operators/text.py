"""Corpus tokenisation, vocabulary and sequence encoding.

Everything is a DataFrame job: tokens are exploded with their positions,
counted with partial aggregation (a hot token such as "the" is combined
map-side), cut at the frequency that fills the vocabulary and ranked.
Encoding is narrow: tokens are looked up where the text lies, in the capped
vocabulary, whose checked size makes it safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import col_
from ..storage import written

# ---------------------------------------------------------------------------
# Special tokens in id order, vocabulary cap, and the word
# pattern (a word, optionally one apostrophe-joined suffix).  Java and RE2
# "\w" are ASCII-only, so letters/digits are spelled as Unicode classes.
# ---------------------------------------------------------------------------
UNK, PAD, BOS, EOS = "<unk>", "<pad>", "<bos>", "<eos>"
SPECIALS = (UNK, PAD, BOS, EOS)
UNK_ID, PAD_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
MAX_VOCAB = 30000
WORD_PATTERN = r"[\p{L}\p{N}_]+(?:[’'][\p{L}\p{N}_]+)?"


def first_nonempty(*cols) -> Column:
    """First non-empty of several text fields, else '' (S9)."""
    return F.coalesce(*[F.nullif(col_(c), F.lit("")) for c in cols], F.lit(""))


def tokenize(text) -> Column:
    """Lower-cased word tokens of a text; missing text -> no tokens."""
    words = F.regexp_extract_all(F.coalesce(col_(text), F.lit("")), F.lit(WORD_PATTERN), 0)
    return F.transform(words, lambda w: F.lower(w))


def positioned_tokens(corpus: DataFrame, id_col: str, text_col: str, side: int = 0) -> DataFrame:
    """(id, side, pos, token) rows; ``side`` orders concatenated corpora."""
    return corpus.select(F.col(id_col).alias("doc_id"), F.lit(side).alias("side"),
                         F.posexplode(tokenize(text_col)).alias("pos", "token"))


def placed(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``place``, a whole number that sorts like ``by`` (equal values, equal numbers)."""
    ranged = rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("place", F.monotonically_increasing_id())
    return ranged.withColumn("place", F.min("place").over(Window.partitionBy(by)))


def appearance(tokens: DataFrame) -> Column:
    """A value that sorts like (side, doc, pos).

    For whole-number documents it is one number of at most 34 digits: hash
    aggregation keeps the least of those in place, whereas for the least struct
    every task would sort all its tokens.  A null document comes first.
    """
    if not isinstance(tokens.schema["doc_id"].dataType, T.IntegralType):
        return F.struct("side", "doc_id", "pos")
    number = lambda x, digits: x.cast(f"decimal({digits},0)")
    doc = F.coalesce(number(F.col("doc_id"), 20), number(F.lit(str(-2 ** 63 - 1)), 20))
    of_side = number(F.col("side"), 10) * number(F.lit(str(2 ** 65)), 20)
    return number(number(doc + of_side, 23) * number(F.lit(str(2 ** 32)), 10) + number(F.col("pos"), 10), 34)


def token_counts(tokens: DataFrame) -> DataFrame:
    """Frequency and first appearance (side, doc, pos) of every token."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.min(appearance(tokens)).alias("first_seen"))


def build_vocab(tokens: DataFrame, max_tokens: int = MAX_VOCAB) -> DataFrame:
    """(token, token_id, freq): specials 0-3, then tokens by descending
    frequency, ties by first appearance, total size <= max_tokens (T2, W3, W5).

    A table of how many tokens have each frequency gives the cut-off
    frequency; only tokens at or above it are sorted, and of those at the
    cut-off itself only the first-seen that still fit are kept.
    """
    spark = tokens.sparkSession
    k = max(0, max_tokens - len(SPECIALS))
    counts = written(token_counts(tokens), "tokens")
    down = Window.orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = counts.groupBy("freq").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(down))
    cut = levels.where(F.col("upto") >= k).agg(F.max(F.struct("freq", (F.col("upto") - F.col("n")).alias("above")))
                                               .alias("x")).select("x.*").collect()[0]
    order = [F.col("freq").desc(), F.col("first_seen").asc()]
    if cut["freq"] is None:
        top = counts
    else:
        ties = _first(counts.where(F.col("freq") == cut["freq"]), "first_seen", k - cut["above"])
        top = counts.where(F.col("freq") > cut["freq"]).unionByName(ties)
    ranked = top.select("token", (F.row_number().over(Window.orderBy(*order)) + len(SPECIALS) - 1)
                        .cast("int").alias("token_id"), "freq")  # at most k rows
    values = ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIALS))
    specials = spark.sql(f"SELECT token, CAST(token_id AS INT) AS token_id, CAST(NULL AS BIGINT) AS freq "
                         f"FROM (VALUES {values}) AS s(token, token_id)")
    return specials.unionByName(ranked)


def _first(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows, found by ranges: only the ranges that begin before n
    are opened, and a range is ranked by itself, so no task sees more than one."""
    ranged = written(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ties")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    opened = ranged.join(starts.where(F.col("start") < n).select("part", "start"), "part")
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return opened.withColumn("place", place).where(F.col("start") + F.col("place") <= n).select(*rows.columns)


BUCKETS = 4096  # of the look-up table; a bucket of a full vocabulary holds about seven tokens


def with_ids(corpus: DataFrame, vocab: DataFrame, tokens: dict[str, str], max_tokens: int = MAX_VOCAB) -> DataFrame:
    """The corpus with a column of ids (key) for every column of token arrays (value) (T3, J5), JVM-side.

    The vocabulary has at most ``max_tokens`` entries (checked).  It becomes
    one value, an array of hash buckets, that a scalar subquery hands to every
    task; a look-up compares the tokens of one bucket, and no token is
    shuffled.  Unknown tokens give <unk>, no tokens give [<unk>] (T4)."""
    vocab = written(vocab.select("token", "token_id"), "vocabulary")
    if vocab.limit(max_tokens + 1).count() > max_tokens:
        raise ValueError(f"a vocabulary has at most {max_tokens} tokens")
    bucket = lambda t: F.pmod(F.hash(t), F.lit(BUCKETS))
    filled = vocab.groupBy(bucket("token").alias("b")).agg(F.collect_list(F.struct("token", "token_id")).alias("es"))
    every = vocab.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(filled, "b", "left")
    table = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "es"))), lambda x: x["es"]).alias("buckets")).scalar()

    def look_up(words: str, buckets: str) -> Column:
        return F.transform(words, lambda t: F.coalesce(
            F.get(F.filter(F.get(buckets, bucket(t)), lambda e: e["token"] == t), F.lit(0))["token_id"], F.lit(UNK_ID)))

    # Spark puts a column that is read once in its reader's place; one read twice
    # becomes part of every row.  So a look-up reads its tokens and a table of its
    # own name once (the table stays out of the rows), and the guard reads the ids.
    tables = {f"__buckets{i}": table for i in range(len(tokens))}
    ids = [look_up(words, b).alias(name) for b, (name, words) in zip(tables, tokens.items())]
    found = corpus.withColumns(tables).select(*corpus.columns, *ids)
    return found.withColumns({name: F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.lit(UNK_ID))) for name in tokens})


def encode_ids(corpus: DataFrame, vocab: DataFrame, id_col: str, text_col: str,
               keep_tokens: int | None = None) -> DataFrame:
    """(id, ids): token ids in text order, unknown -> <unk>, empty -> [<unk>]
    (T3, T4, J5).

    ``keep_tokens`` limits the look-up to the first tokens of each text when
    the caller truncates to that length anyway (exact: the id of a token
    does not depend on the tokens after it).
    """
    return encode_columns(corpus, vocab, [id_col], {"ids": text_col}, keep_tokens)


def encode_columns(corpus: DataFrame, vocab: DataFrame, keys: list[str], texts: dict[str, str],
                   keep_tokens: int | None = None) -> DataFrame:
    """Ids of several text columns over one scan; every text is tokenised once."""
    words = {name: f"__tokens_{name}" for name in texts}
    cut = lambda toks: toks if keep_tokens is None else F.slice(toks, 1, keep_tokens)
    tokens = corpus.select(*keys, *[cut(tokenize(c)).alias(words[name]) for name, c in texts.items()])
    return with_ids(tokens, vocab, words).select(*keys, *texts)


def truncate(ids, max_len: int) -> Column:
    """Classification form: first ``max_len`` ids (T5)."""
    return F.slice(col_(ids), 1, max_len)


def wrap_truncate(ids, max_len: int) -> Column:
    """Sequence form: <bos> ids <eos>, then cut to ``max_len``."""
    return F.slice(F.concat(F.array(F.lit(BOS_ID)), col_(ids), F.array(F.lit(EOS_ID))), 1, max_len)


def pad(ids, max_len: int) -> tuple[Column, Column]:
    """(padded ids of exactly ``max_len``, true length min(len, max_len))."""
    c = col_(ids)
    padded = F.slice(F.concat(c, F.array_repeat(F.lit(PAD_ID), max_len)), 1, max_len)
    return padded, F.least(F.size(c), F.lit(max_len)).cast("bigint")


def ids_text(ids) -> Column:
    """Space-separated form of an id array (for display / comparison)."""
    return F.array_join(F.transform(col_(ids), lambda x: x.cast("string")), " ")
