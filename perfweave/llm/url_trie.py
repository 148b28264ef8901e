"""URL filter by one trie over reversed host labels and path segments.

A rule is (host, path, verdict).  It fits a url whose host is the rule's host
or a subdomain of it and whose path starts with the rule's path.  The trie's
first edges are host labels from the last one on; below every host node hang
the path segments that a slash closes; what follows a rule path's last slash
is kept at its node as a prefix of the next segment.  One walk down the trie
sees every rule that fits a url.  The longest match wins: more host labels
first, then the longer path; where one rule is listed with both verdicts,
block wins.  Urls without a fitting rule get the default verdict.

The trie is built on the driver and broadcast while the rules are at most
``max_rules`` rows of at most MAX_RULE_CHARS characters in all; beyond either
bound the same matches are found by a join: each distinct url offers its
(host suffix, closed path prefix) keys, and the rules are shuffled to them.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
in lower case (a port or user name belongs to it, as written).  Path: from
there up to ``?``, ``#`` or the end.  A null url and one without ``://`` have
an empty host and path and fit no rule.  Hosts of rules are lower-cased
likewise; an empty rule host fits every url that has ``://``; rules with a
null host, path or verdict are refused, and so are verdicts other than allow
and block.  Null and repeated page_ids are judged like any row; other columns
are ignored by ``judge`` and kept by ``allowed``; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfweave.llm.common import code_on_workers, written

ALLOW, BLOCK = "allow", "block"
MAX_RULES = 2_000_000
MAX_RULE_CHARS = 64_000_000

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = str.maketrans(_UPPER, _SMALL)

# The rules of the registered query.
RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
         ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))


def parse(url: str | None) -> tuple[str, str, bool]:
    """(host, path, whether the url has ``://``)."""
    if url is None:
        return "", "", False
    at = url.find("://")
    if at < 0:
        return "", "", False
    rest = url[at + 3:]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path, True


def labels(host: str) -> list[str]:
    """Labels of a host, last first (none for the empty host)."""
    return host.split(".")[::-1] if host else []


class Node:
    """Trie node: host children, path children, and the rules that end here,
    as {rest of the path after its last slash: (rule, verdict)}."""

    __slots__ = ("hosts", "paths", "ends")

    def __init__(self):
        self.hosts, self.paths, self.ends = {}, {}, {}


def build(rules) -> Node:
    """Trie of (host, path, verdict) rules."""
    root = Node()
    for host, path, verdict in rules:
        host = host.translate(_LOWER)
        node = root
        for label in labels(host):
            node = node.hosts.setdefault(label, Node())
        *closed, tail = path.split("/")
        for segment in closed:
            node = node.paths.setdefault(segment, Node())
        if verdict == BLOCK or tail not in node.ends:
            node.ends[tail] = (host + path, verdict)
    return root


def _below(node: Node, segments: list[str]):
    """The longest rule of one host node that starts the path."""
    found = None
    for i, segment in enumerate(segments):
        fits = [t for t in node.ends if segment.startswith(t)]
        if fits:
            found = node.ends[max(fits, key=len)]
        if i == len(segments) - 1:  # the last segment is not closed by a slash
            break
        node = node.paths.get(segment)
        if node is None:
            break
    return found


def match(root: Node, host: str, path: str):
    """(rule, verdict) of the longest match, or None."""
    segments = path.split("/")
    found, node = _below(root, segments), root
    for label in labels(host):
        node = node.hosts.get(label)
        if node is None:
            break
        found = _below(node, segments) or found
    return found


SCHEMA = "page_id long, url string, host string, path string, rule string, verdict string"
COLUMNS = ("page_id", "host", "path", "rule", "verdict")


def _by_trie(pages: DataFrame, rules: list, default: str) -> DataFrame:
    import pyarrow as pa

    shared = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in rules])  # at most MAX_RULES, MAX_RULE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = build(shared.value)
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path, whole = parse(url)
                out.append((host, path, *((match(root, host, path) if whole else None) or (None, default))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([r[i] for r in out], pa.string()) for i in range(4))],
                names=["page_id", "url", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, SCHEMA)


def _by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same matches with the rules shuffled, whatever their number."""
    rest = F.regexp_extract("url", r"(?s)^.*?://([^?#]*)", 1)
    has = F.coalesce(F.contains("url", F.lit("://")), F.lit(False))
    urls = pages.select("url").distinct().withColumn("has", has).withColumn("rest", F.when(F.col("has"), rest).otherwise(""))
    urls = urls.select("url", "has", F.translate(F.regexp_extract("rest", "^[^/]*", 0), _UPPER, _SMALL).alias("host"),
                       F.regexp_extract("rest", "(?s)/.*$", 0).alias("path"))
    urls = written(urls, "urls")
    of_host, of_path = F.split("host", r"\."), F.split("path", "/")
    # Host suffixes (the empty one too) and closed path prefixes with the segment that follows.
    n = F.size("hs")
    suffixes = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(
        F.array_join(F.slice("hs", n - k + 1, k), ".").alias("suffix"), k.alias("depth")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("ps") - 1), lambda k: F.struct(
        F.array_join(F.transform(F.slice("ps", F.lit(1), k), lambda s: F.concat(s, F.lit("/"))), "").alias("closed"),
        F.element_at("ps", k + 1).alias("segment")))
    offers = (urls.where("has").withColumns({"hs": F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(of_host),
                                             "ps": of_path})
              .select("url", F.explode(suffixes).alias("h"), "ps").select("url", "h", F.explode(prefixes).alias("p"))
              .select("url", F.when(F.col("h.suffix") != "", F.col("h.depth")).otherwise(0).alias("depth"), F.col("h.suffix").alias("suffix"), F.col("p.closed").alias("closed"), "p.segment"))
    keyed = rules.select(F.translate("host", _UPPER, _SMALL).alias("suffix"), "path", "verdict").select(
        "suffix", F.regexp_extract("path", "(?s)^.*/", 0).alias("closed"), F.regexp_extract("path", "[^/]*$", 0).alias("tail"),
        "path", "verdict")
    best = (offers.join(keyed, ["suffix", "closed"]).where(F.startswith("segment", "tail"))
            .groupBy("url").agg(F.max(F.struct("depth", F.length("path").alias("size"), (F.col("verdict") == BLOCK).alias("blocks"),
                                               F.concat("suffix", "path").alias("rule"), "verdict")).alias("m"))
            .select(F.col("url").alias("_url"), "m"))
    judged = urls.join(best, F.col("url") == F.col("_url"), "left").select(
        F.col("url").alias("_url"), "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").join(
        judged, F.col("url").eqNullSafe(F.col("_url"))).select("page_id", "url", "host", "path", "rule", "verdict")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def _judged(pages: DataFrame, rules, default: str, max_rules: int) -> DataFrame:
    """COLUMNS and url of every row of (page_id, url)."""
    spark = pages.sparkSession
    code_on_workers(spark)
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, rules)
    rules = rules.select("host", "path", "verdict")
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("c"),
                     F.count_if(~F.coalesce(F.col("verdict").isin(ALLOW, BLOCK), F.lit(False))
                                | F.col("host").isNull() | F.col("path").isNull()).alias("bad")).collect()[0]
    if size["bad"] or default not in (ALLOW, BLOCK):
        raise ValueError("a rule needs a host, a path and the verdict allow or block")
    if size["n"] <= max_rules and size["c"] <= MAX_RULE_CHARS:
        return _by_trie(pages, rules.collect(), default)  # bounded by the two figures just read
    return _by_join(pages, rules, default)


def judge(pages: DataFrame, rules, default: str = ALLOW, max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules``: (host, path, verdict) tuples or a DataFrame with these columns.
    """
    return _judged(pages, rules, default, max_rules).select(*COLUMNS)


def allowed(pages: DataFrame, rules, default: str = ALLOW, max_rules: int = MAX_RULES) -> DataFrame:
    """The pages, with all their columns, whose url is not blocked."""
    urls = pages.select(F.lit(0).cast("long").alias("page_id"), "url").distinct()
    gone = _judged(urls, rules, default, max_rules).where(F.col("verdict") == BLOCK).select(F.col("url").alias("_gone"))
    return pages.join(gone, pages["url"].eqNullSafe(F.col("_gone")), "left_anti")


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS k FROM pages),
r AS (SELECT page_id, k > 0 AS has, CASE WHEN k > 0 THEN regexp_extract(substr(url, k + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
p AS (SELECT page_id, has, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '/(.|\n)*$') AS path FROM r),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, host, path, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule,
             first(rule_verdict ORDER BY length(rule_host || rule_path) DESC) AS v
      FROM (SELECT DISTINCT page_id, has, host, path FROM p) JOIN rules
        ON has AND ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
      GROUP BY ALL)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.host = m.host AND p.path = m.path
"""
