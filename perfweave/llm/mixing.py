"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain -> language -> source; leaves hold documents.  The root's
budget is a share of the corpus tokens.  Every node's budget is dealt to its
children in proportion to their weights, no child getting more than its
capacity (its tokens times ``max_epochs``); what a short child leaves is dealt
again among its siblings.  A subtree that cannot hold its share is itself a
short child one level up, so shortages go to siblings first and to the
ancestors' siblings after that.  Each leaf then takes its budget as whole
seeded epochs and a token prefix of one more epoch: documents in the order of
md5(seed:epoch:doc_id), as long as their running token sum stays within the
budget.

Dealing needs no iteration: with children sorted by capacity / weight, child
k is full exactly when that ratio is at most (budget - capacities before k) /
(weights from k on).  The prefix needs no leaf in one task: tokens are summed
per (leaf, first hex digits of the md5), and only the one slice that holds
the cut is ordered row by row.

Defined cases: null domain, language or source are values of their own;
null or blank texts have no tokens and ride along with their epoch; equal
md5 keys (repeated rows) are taken or left together; leaves without a weight
get ``default_weight``; an empty table gives an empty result; extra columns
pass through ``select_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfweave.llm.common import WORD, written
from perfweave.operators.joins import bounded_broadcast

LEVELS = ("_domain", "_lang", "_source")
SLICE_DIGITS = 3  # 4,096 slices of a leaf


def domain_of(source: Column) -> Column:
    """Domain of a source name: the first hex digit of its md5 deals sources to four domains."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("domain"), F.floor(digit / 4).cast("string"))


def weight_of(level: str, value: Column) -> Column:
    """Target weight of a child: languages and domains by table, sources equally."""
    if level == "_lang":
        return (F.when(value == "en", F.lit(4.0)).when(value == "es", F.lit(3.0)).when(value == "fr", F.lit(2.0))
                .otherwise(F.lit(1.0)))
    if level == "_domain":
        return (F.when(value == "domain0", F.lit(1.0)).when(value == "domain1", F.lit(2.0))
                .when(value == "domain2", F.lit(3.0)).otherwise(F.lit(4.0)))
    return F.lit(1.0)


def with_leaf(docs: DataFrame, domain=domain_of) -> DataFrame:
    return (docs.withColumn("_domain", domain(F.col("source"))).withColumn("_lang", F.col("lang"))
            .withColumn("_source", F.col("source")))


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def epoch_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in a leaf's epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _deal(nodes: DataFrame, parents: DataFrame | None, level: int, budget: Column) -> DataFrame:
    """Budgets of one level's nodes from their parents' budgets."""
    up, name = list(LEVELS[:level]), LEVELS[level]
    caps = nodes.groupBy(*LEVELS[:level + 1]).agg(F.sum("cap").alias("cap")).withColumn(
        "w", weight_of(name, F.col(name)))
    if parents is None:
        caps = caps.withColumn("budget", budget)
    else:
        keyed = parents.select(*[F.col(c).alias(f"p{c}") for c in up], F.col("alloc").alias("budget"))
        on = F.lit(True)
        for c in up:
            on = on & F.col(c).eqNullSafe(F.col(f"p{c}"))
        caps = caps.join(keyed, on).drop(*[f"p{c}" for c in up])
    by = Window.partitionBy(*up) if up else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    # The dealing rate is that of the first child that is not full.
    first_open = F.min(F.when(F.col("cap") > F.col("rate") * F.col("w"), F.struct(
        F.col("cap") / F.col("w"), F.col(name).isNotNull(), F.col(name), F.col("rate")))).over(by)
    return (caps.withColumn("rate", left).withColumn("rate", first_open["rate"])
            .withColumn("alloc", F.coalesce(F.least(F.col("cap"), F.col("rate") * F.col("w")), F.col("cap")))
            .select(*LEVELS[:level + 1], "cap", "w", "alloc"))


def budgets(leaves: DataFrame, budget_share: float, max_epochs: int) -> DataFrame:
    """(leaf, tokens, alloc): the leaf's budget in tokens, a whole number."""
    nodes = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0).cast("long"))).collect()[0][0]  # one number
    level = None
    for i in range(len(LEVELS)):
        level = _deal(nodes, level, i, F.lit(float(int(total * budget_share))))
    got = level.select(*[F.col(c).alias(f"l{c}") for c in LEVELS], F.floor("alloc").cast("long").alias("alloc"))
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"l{c}"))
    return leaves.join(got, on).drop(*[f"l{c}" for c in LEVELS])


def cuts(counted: DataFrame, seed: int, budget_share: float, max_epochs: int) -> DataFrame:
    """(leaf, full_epochs, cut): whole epochs of a leaf, and the last md5 key
    that its partial epoch (number ``full_epochs``) takes (null: none)."""
    leaves = written(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = written(budgets(leaves, budget_share, max_epochs)
                   .withColumn("full_epochs", F.when(F.col("tokens") > 0, F.floor(F.col("alloc") / F.col("tokens")))
                               .otherwise(F.lit(0)).cast("int"))
                   .withColumn("rest", F.col("alloc") - F.col("full_epochs") * F.col("tokens"))
                   .select(*[F.col(c).alias(f"l{c}") for c in LEVELS], "alloc", "full_epochs", "rest"), "budgets")
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"l{c}"))
    keyed = (counted.join(bounded_broadcast(plan), on).drop(*[f"l{c}" for c in LEVELS])
             .withColumn("key", epoch_key(seed, F.col("full_epochs"), F.col("doc_id")))
             .withColumn("slice", F.substring("key", 1, SLICE_DIGITS)))
    slices = keyed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("upto", F.sum("t").over(run)).withColumn("base", F.col("upto") - F.col("t"))
    # The slice that the budget ends in: the first whose running sum exceeds it.
    inside = (slices.where((F.col("upto") > F.col("rest")) & (F.col("base") <= F.col("rest")))
              .groupBy(*LEVELS).agg(F.min(F.struct("slice", "base")).alias("x"))
              .select(*[F.col(c).alias(f"s{c}") for c in LEVELS], F.col("x.slice").alias("at"), F.col("x.base").alias("base")))
    on = F.col("slice") == F.col("at")
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"s{c}"))
    rows = (keyed.join(bounded_broadcast(written(inside, "slices")), on).groupBy(*LEVELS, "base", "rest", "key")
            .agg(F.sum("n_tokens").alias("t")))
    run = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (rows.withColumn("upto", F.col("base") + F.sum("t").over(run)).where(F.col("upto") <= F.col("rest"))
             .groupBy(*LEVELS).agg(F.max("key").alias("last")))
    # Slices before the cut are taken whole: their keys sort before ``at``.
    ends = inside.join(taken.select(*[F.col(c).alias(f"t{c}") for c in LEVELS], "last"),
                       _same("s", "t"), "left").drop(*[f"t{c}" for c in LEVELS])
    out = plan.join(ends, _same("l", "s"), "left").drop(*[f"s{c}" for c in LEVELS])
    return out.withColumn("cut", F.when(F.col("rest") <= 0, F.lit(None).cast("string")).otherwise(
        F.coalesce(F.col("last"), F.col("at"), F.lit("g")))).select(*[f"l{c}" for c in LEVELS], "alloc", "full_epochs", "cut")


def _same(a: str, b: str) -> Column:
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
    return on


def _expanded(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Each document once for every epoch that takes it, as column ``_epoch``."""
    on = F.lit(True)
    for c in LEVELS:
        on = on & F.col(c).eqNullSafe(F.col(f"l{c}"))
    last = F.when(epoch_key(seed, F.col("full_epochs"), F.col("doc_id")) <= F.col("cut"), 1).otherwise(0)
    n = F.col("full_epochs") + F.coalesce(last, F.lit(0))
    return (docs.join(bounded_broadcast(plan), on).withColumn("_n", n).where("_n > 0")
            .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))


def plan_for(docs: DataFrame, seed: int, budget_share: float, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """(counted documents, leaf plan), both written tables."""
    counted = written(with_leaf(docs.select("doc_id", "lang", "source", tokens(F.col("text")).alias("n_tokens")))
                      .select("doc_id", *LEVELS, "n_tokens"), "tokens")
    return counted, written(cuts(counted, seed, budget_share, max_epochs), "plan")


def selection(docs: DataFrame, seed: int = 17, budget_share: float = 0.6, max_epochs: int = 4) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens) of every selected document and epoch."""
    counted, plan = plan_for(docs, seed, budget_share, max_epochs)
    return _expanded(counted, plan, seed).select(
        "doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
        F.col("_epoch").alias("epoch"), "n_tokens")


def select_documents(docs: DataFrame, seed: int = 17, budget_share: float = 0.6, max_epochs: int = 1) -> DataFrame:
    """The selected documents with all their columns; one row for each epoch that takes them."""
    _, plan = plan_for(docs, seed, budget_share, max_epochs)
    # The input row travels as one struct, so its column names cannot clash.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "lang", "source")
    return _expanded(with_leaf(row).drop("lang", "source"), plan, seed).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns])


def oracle_sql(seed: int = 17, budget_share: float = 0.6, max_epochs: int = 4) -> str:
    """The selection as DuckDB SQL over ``documents``."""
    weight = {
        "d": "CASE d WHEN 'domain0' THEN 1.0 WHEN 'domain1' THEN 2.0 WHEN 'domain2' THEN 3.0 ELSE 4.0 END",
        "l": "CASE l WHEN 'en' THEN 4.0 WHEN 'es' THEN 3.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END",
        "s": "1.0",
    }

    def deal(step: int, keys: list[str]) -> str:
        name, up = keys[-1], keys[:-1]
        by = f"PARTITION BY {', '.join(up)}" if up else ""
        budget = (f"JOIN a{step - 1} p ON " + " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in up)
                  if up else "")
        share = "p.alloc" if up else f"(SELECT CAST(floor(sum(tokens) * {budget_share}) AS DOUBLE) FROM leaves)"
        cols, ncols = ", ".join(keys), ", ".join(f"n.{k}" for k in keys)
        return f"""
c{step} AS (SELECT {ncols}, n.cap, n.w, {share} AS budget FROM (
    SELECT {cols}, sum(cap) AS cap, CAST({weight[name]} AS DOUBLE) AS w
    FROM (SELECT *, CAST(tokens AS DOUBLE) * {max_epochs} AS cap FROM leaves) GROUP BY {cols}) n {budget}),
r{step} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {name} NULLS FIRST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({by} ORDER BY cap / w, {name} NULLS FIRST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
        row_number() OVER ({by} ORDER BY cap / w, {name} NULLS FIRST) AS pos FROM c{step}),
a{step} AS (SELECT {cols}, coalesce(least(cap, w * arg_min(rate, pos) FILTER (WHERE cap > rate * w) OVER ({by})), cap) AS alloc
    FROM r{step})"""

    return rf"""
WITH t AS (SELECT doc_id, lang AS l, source AS s,
        'domain' || CAST(floor((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) / 4) AS INT) AS d,
        len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens FROM documents),
leaves AS (SELECT d, l, s, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY d, l, s),{deal(0, ["d"])},{
        deal(1, ["d", "l"])},{deal(2, ["d", "l", "s"])},
plan AS (SELECT x.d, x.l, x.s, x.tokens, CAST(floor(alloc) AS BIGINT) AS alloc,
        CASE WHEN x.tokens > 0 THEN CAST(floor(floor(alloc) / x.tokens) AS INT) ELSE 0 END AS full_epochs
        FROM leaves x JOIN a2 ON x.d = a2.d AND x.l IS NOT DISTINCT FROM a2.l AND x.s IS NOT DISTINCT FROM a2.s),
k AS (SELECT t.*, full_epochs, alloc - full_epochs * tokens AS rest,
        md5('{seed}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
        FROM t JOIN plan p ON t.d = p.d AND t.l IS NOT DISTINCT FROM p.l AND t.s IS NOT DISTINCT FROM p.s),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM k),
n AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM u)
SELECT doc_id, d AS domain, l AS lang, s AS source, CAST(unnest(generate_series(0, times - 1)) AS INT) AS epoch,
       CAST(n_tokens AS BIGINT) AS n_tokens FROM n WHERE times > 0
"""
