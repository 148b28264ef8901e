"""Preference formatting of chosen and rejected conversations (DataFrame functions only).

Input: turns (pair_id, side, turn, role, text) with side ``chosen`` or
``rejected``.  The longest common prefix of a pair is the run of turns, from
the first, whose role and text are equal on both sides.  It is rendered once,
as the prompt; the turns after it are rendered as the two completions.  The
result is one row per rendered segment, in the order (pair_id, part, seq):
part is ``prompt``, ``chosen`` or ``rejected``, and ``trained`` marks the
segments that a loss would count: assistant turns of completions.  Segments
instead of whole strings keep a conversation of any length in bounded memory;
``assemble`` joins them where conversations are known to be short.

Everything is keyed by (pair_id, turn): the prefix length is the smallest
position at which the sides differ, a partial aggregate, so a pair that holds a
third of all turns is never gathered in one task.

Defined cases: turns are numbered 0, 1, ... and a gap ends the prefix;
null role or text count as empty strings; repeated (pair, side, turn)
rows count once (the smallest role and text); a pair with one side only has
an empty prefix; a pair with equal sides is all prompt, with no completions;
null pair_id or turn rows are left out; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turn template: fixed values of the rendered format.
TURN_OPEN, TURN_MID, TURN_CLOSE = "<|", "|>\n", "\n"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), role, F.lit(TURN_MID), text, F.lit(TURN_CLOSE))


def segments(turns: DataFrame) -> DataFrame:
    """Rendered segments of all pairs: pair_id, part, seq, role, segment, trained."""
    one = (turns.where(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()
                       & F.col("side").isin("chosen", "rejected"))
           .groupBy("pair_id", F.col("turn").cast("long").alias("turn"))
           .agg(*[F.min(F.when(F.col("side") == s, F.struct(
               F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias(s)
               for s in ("chosen", "rejected")]))
    # Position of the first difference; a side that ends, or a gap, differs.
    differs = ~F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False))
    ends = one.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differs, F.col("turn"))), F.max("turn") + 1).alias("first"),
        F.min("turn").alias("lowest"), F.count(F.lit(1)).alias("n"), F.max("turn").alias("highest"))
    # Gaps are rare: only a pair whose turns are not 0..n-1 looks for the first missing turn.
    present = one.select("pair_id", "turn")
    gap = (present.join(ends.where((F.col("lowest") != 0) | (F.col("n") != F.col("highest") + 1)).select("pair_id"),
                        "pair_id", "left_semi"))
    follows = present.select("pair_id", (F.col("turn") + 1).alias("turn"))
    starts = (gap.where("turn > 0").join(follows, ["pair_id", "turn"], "left_anti")
              .groupBy("pair_id").agg(F.min("turn").alias("after_gap")))
    ends = ends.join(starts, "pair_id", "left").select(
        "pair_id", F.least(F.col("first"), F.coalesce(F.col("after_gap"), F.col("first"))).alias("prefix"))
    sided = one.join(ends, "pair_id")
    parts = F.when(F.col("turn") < F.col("prefix"), F.array(F.struct(
        F.lit("prompt").alias("part"), F.col("chosen").alias("x")))).otherwise(F.filter(F.array(
            *[F.struct(F.lit(s).alias("part"), F.col(s).alias("x")) for s in ("chosen", "rejected")]),
            lambda p: p["x"].isNotNull()))
    return (sided.select("pair_id", "turn", "prefix", F.explode(parts).alias("p")).select(
        "pair_id", F.col("p.part").alias("part"),
        F.when(F.col("p.part") == "prompt", F.col("turn")).otherwise(F.col("turn") - F.col("prefix")).alias("seq"),
        F.col("p.x.role").alias("role"), render(F.col("p.x.role"), F.col("p.x.text")).alias("segment"),
        ((F.col("p.part") != "prompt") & (F.col("p.x.role") == "assistant")).alias("trained")))


def assemble(rendered: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected and the trained ranges of the
    completions (start:end in code points).  For conversations that fit a row."""
    ordered = rendered.groupBy("pair_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "segment", "trained"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["segment"]), "")
    spans = F.aggregate(
        "s", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["segment"])).alias("at"), F.when(x["trained"], F.concat(
            a["out"], F.array(F.concat_ws(":", a["at"].cast("string"),
                                          (a["at"] + F.length(x["segment"])).cast("string"))))).otherwise(a["out"]).alias("out")),
        lambda a: F.array_join(a["out"], ","))
    return ordered.select("pair_id", "part", text.alias("text"), spans.alias("spans")).groupBy("pair_id").agg(
        *[F.coalesce(F.max(F.when(F.col("part") == p, F.col("text"))), F.lit("")).alias(p)
          for p in ("prompt", "chosen", "rejected")],
        *[F.coalesce(F.max(F.when(F.col("part") == p, F.col("spans"))), F.lit("")).alias(f"{p}_trained")
          for p in ("chosen", "rejected")])


def answer_swaps(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: the chosen side of pair p is
    conversation p; the rejected side is the same up to its last assistant
    turn, which is replaced by that of the neighbour (2k with 2k + 1).  A
    conversation without that turn on either side keeps its own ending."""
    turns = conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    last = (turns.where(F.col("role") == "assistant").groupBy("conv_id")
            .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
            .select(F.col("conv_id"), F.col("x.turn").alias("last_turn"), F.col("x.text").alias("answer")))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("answer").alias("swap"))
    ends = last.select("conv_id", "last_turn").join(other, "conv_id")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = turns.join(ends, "conv_id", "left").where(F.col("last_turn").isNull() | (F.col("turn") <= F.col("last_turn"))).select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role",
        F.when(F.col("turn") == F.col("last_turn"), F.col("swap")).otherwise(F.col("text")).alias("text"))
    return chosen.unionByName(rejected)


def digest(conversations: DataFrame) -> DataFrame:
    return segments(answer_swaps(conversations))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
e AS (SELECT a.conv_id, a.last_turn, b.answer AS swap FROM l a JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
r AS (SELECT t.conv_id, t.turn, t.role, CASE WHEN t.turn = e.last_turn THEN e.swap ELSE t.text END AS text
      FROM t LEFT JOIN e USING (conv_id) WHERE e.last_turn IS NULL OR t.turn <= e.last_turn),
j AS (SELECT t.conv_id, t.turn, t.role, t.text, r.role AS r_role, r.text AS r_text, r.conv_id IS NOT NULL AS there
      FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.turn = t.turn),
p AS (SELECT conv_id, coalesce(min(turn) FILTER (WHERE NOT there OR role <> r_role OR text <> r_text), max(turn) + 1) AS prefix
      FROM j GROUP BY conv_id),
s AS (SELECT conv_id, CASE WHEN turn < prefix THEN 'prompt' ELSE 'chosen' END AS part,
             CASE WHEN turn < prefix THEN turn ELSE turn - prefix END AS seq, role, text FROM j JOIN p USING (conv_id)
      UNION ALL
      SELECT conv_id, 'rejected', turn - prefix, r_role, r_text FROM j JOIN p USING (conv_id) WHERE there AND turn >= prefix)
SELECT conv_id AS pair_id, part, seq, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS segment,
       part <> 'prompt' AND role = 'assistant' AS trained FROM s
"""
