"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from perfweave.llm import (gnat_negatives, jaccard_adaptive, langid_gru, mixing, packing_bestfit, preference, quality_risk,
                           secrets_markov, spelling_variants, substring_cover, topk_pivots, toxicity_fm, url_trie)
from perfweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _op6(spark, sf_dir):
    out = quality_risk.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


def _op7(spark, sf_dir):
    return jaccard_adaptive.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "class_id")


REGISTRY: dict[str, Query] = {
    "pipeline": corpus_pipeline.run,
    "op1_topk_pivots": lambda s, d: topk_pivots.top_k(table(s, d, "embeddings")),
    "op2_preference_format": lambda s, d: preference.digest(table(s, d, "conversations")),
    "op3_toxicity_fm": lambda s, d: toxicity_fm.digest(table(s, d, "documents"), table(s, d, "labels")),
    "op4_mixing_budgets": lambda s, d: mixing.selection(table(s, d, "documents")),
    "op5_substring_cover": lambda s, d: substring_cover.digest(table(s, d, "documents")),
    "op6_quality_risk": _op6,
    "op7_jaccard_adaptive": _op7,
    "op8_langid_gru": lambda s, d: langid_gru.digest(table(s, d, "documents")),
    "op9_secrets_markov": lambda s, d: secrets_markov.digest(table(s, d, "documents")),
    "op10_packing_bestfit": lambda s, d: packing_bestfit.pack(table(s, d, "documents")),
    "op11_url_trie": lambda s, d: url_trie.judge(table(s, d, "pages"), url_trie.RULES),
    "op12_gnat_negatives": lambda s, d: gnat_negatives.mine(table(s, d, "embeddings"), label=gnat_negatives.noisy_label),
    "op13_spelling_variants": lambda s, d: spelling_variants.group(table(s, d, "documents"), every=spelling_variants.EVERY),
}

_TOPK_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM w, unnest(range(1, len(w) - 48)) AS u(i)),
m AS (SELECT g, min(doc_id) AS least FROM k GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN m USING (g) WHERE least < doc_id),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
o AS (SELECT doc_id, p, w[p] AS word, g.ps IS NOT NULL AND list_contains(g.ps, p) AS removed
      FROM w LEFT JOIN g USING (doc_id), unnest(range(1, len(w) + 1)) AS u(p)),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE removed) AS r,
             coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed), '') AS kept FROM o GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
        THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
top AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a),
cls AS (SELECT h, min(doc_id) AS class_id FROM n GROUP BY h)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
       coalesce(class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN top USING (doc_id) LEFT JOIN cls USING (h)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_topk_pivots": _TOPK_SQL,
    "op5_substring_cover": _SUBSTRING_SQL,
    "op7_jaccard_adaptive": _JACCARD_SQL,
    "op2_preference_format": preference.ORACLE,
    "op4_mixing_budgets": mixing.oracle_sql(),
    "op11_url_trie": url_trie.ORACLE,
    "op12_gnat_negatives": gnat_negatives.ORACLE,
    "op13_spelling_variants": spelling_variants.ORACLE,
}
