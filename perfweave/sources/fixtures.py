"""Adapter views: the driver's synthetic tables seen as benchmark telemetry.

The workflow's own inputs (trial tables, step logs, layer tables, corpora,
image manifests) are not shipped, so these views derive them from the
driver's tables.  Each view is one SQL text with ``{table}`` placeholders:
Spark runs it with ``spark.sql(text, table=DataFrame)`` (no global view
names, Catalyst plans it like any query) and the DuckDB oracle runs the same
text on its pre-registered tables, so both sides start from equal inputs.

The GPU specification dimension is a static 9-row literal (fixture values,
not vendor data): it is the only input broadcast without a runtime size
check, because its size is fixed in the code.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..storage import delete_at_exit
from .tables import read_table

# ---------------------------------------------------------------------------
# View SQL (dialect-neutral: runs unchanged in Spark SQL and DuckDB).
# ---------------------------------------------------------------------------

GPU_NAME_CASE = """CASE l_suppkey % 10
    WHEN 0 THEN 'NVIDIA A100 80GB PCIe'   WHEN 1 THEN 'NVIDIA H100 PCIe'
    WHEN 2 THEN 'NVIDIA L4'               WHEN 3 THEN 'NVIDIA L40S'
    WHEN 4 THEN 'NVIDIA A40'              WHEN 5 THEN 'NVIDIA GeForce RTX 5090'
    WHEN 6 THEN 'NVIDIA RTX 4000 Ada Generation'
    WHEN 7 THEN 'Tesla V100-SXM2-32GB'    WHEN 8 THEN 'Tesla T4'
    ELSE 'Mystery GPU' END"""

# One CNN-family trial per lineitem row (raw: before derived columns).
RAW_TRIALS_SQL = f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  {GPU_NAME_CASE} AS gpu_name,
  p_type AS model, p_brand AS dataset, 'CNN' AS architecture,
  CAST(least(CASE l_linenumber % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 16 END,
             CASE l_suppkey % 10 WHEN 2 THEN 8 ELSE 16 END) AS BIGINT) AS vcpu,
  CASE l_linestatus WHEN 'O' THEN 'NVME' ELSE 'SSD' END AS storage,
  CAST(CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 32 WHEN 1 THEN 64 WHEN 2 THEN 128
       ELSE 256 END AS BIGINT) AS batch_size,
  CAST(CASE l_returnflag WHEN 'R' THEN 32 ELSE 16 END AS BIGINT) AS prec_bits,
  CASE l_orderkey % 2 WHEN 0 THEN 'SGD' ELSE 'AdamW' END AS optimizer,
  CAST(CASE l_orderkey % 3 WHEN 0 THEN '0.0005' WHEN 1 THEN '0.001' ELSE '0.002' END AS DOUBLE)
    AS learning_rate,
  CAST(round(p_retailprice * 10000) AS BIGINT) AS param_count,
  CAST(p_size AS DOUBLE) * 1.0e8 AS flops_fwd_per_sample,
  CAST(p_size AS BIGINT) * 100000 * (CASE l_returnflag WHEN 'R' THEN 4 ELSE 2 END)
    AS act_bytes_per_sample_proxy,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_extendedprice / 1000.0 END AS T_gpu_ms,
  l_tax * 100.0 AS T_cpu_io_ms,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_extendedprice / 1000.0 + l_tax * 100.0 END
    AS avg_batch_time_ms,
  CAST((l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber) % 5 AS BIGINT) AS fold
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
"""

# Raw step log: one row per training step (trial = user).
STEPS_SQL = """
SELECT user_id AS trial_id, ts, event_id,
  value * 0.25 AS loader_ms, value * 0.75 AS compute_ms,
  CAST(32 AS INT) AS n_examples, CAST(event_id % 128 AS INT) AS n_tokens,
  event_type = 'error' AS oom,
  event_type <> 'error' OR event_id % 2 = 0 AS fwd_done
FROM {events}
"""

# Layer table: one row per hooked layer of a network (network = brand).
LAYERS_SQL = """
SELECT p_brand AS model, CAST(p_partkey AS INT) AS layer_idx,
  CASE p_type WHEN 'ECONOMY' THEN 'conv' WHEN 'LARGE' THEN 'conv' WHEN 'MEDIUM' THEN 'linear'
              WHEN 'PROMO' THEN 'bn' WHEN 'SMALL' THEN 'act' ELSE 'pool' END AS kind,
  CAST(p_size AS INT) AS c_in,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE p_size * 2 END AS INT) AS c_out,
  CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS INT) AS kh,
  CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS INT) AS kw,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 32 WHEN 1 THEN 16 WHEN 2 THEN 8 ELSE 4 END AS INT) AS h_out,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 32 WHEN 1 THEN 16 WHEN 2 THEN 8 ELSE 4 END AS INT) AS w_out,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN p_size WHEN p_partkey % 7 = 1 THEN 2 ELSE 1 END AS INT)
    AS groups,
  CAST(p_size * 10 AS INT) AS in_features, CAST(p_size * 5 AS INT) AS out_features,
  CAST(p_size AS BIGINT) * 1024 AS act_scalars,
  CAST(round(p_retailprice) AS BIGINT) AS n_params
FROM {part}
"""

# Text corpus (classification form).
CORPUS_SQL = "SELECT doc_id, text FROM {documents}"

# Pair corpus: a user turn and the assistant turn that follows it; the
# conversation's system prompt is the fallback source text.  The key holds
# both numbers at full width: no two turns share it, and it sorts like them.
PAIRS_SQL = """
SELECT lpad(CAST(u.conv_id AS STRING), 20, '0') || ':' || lpad(CAST(u.turn AS STRING), 20, '0') AS pair_id, u.text AS src_primary, s.text AS src_fallback,
       a.text AS tgt_primary, CAST(NULL AS STRING) AS tgt_fallback
FROM {conversations} u
LEFT JOIN {conversations} a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN {conversations} s
  ON s.conv_id = u.conv_id AND s.turn = 0 AND s.role = 'system'
WHERE u.role = 'user'
"""

# Image-folder manifest stand-in: every page is a sample; its class folder is
# the language segment of the URL path.
PAGES_SQL = """
SELECT url AS path, regexp_extract(url, '^[a-z]+://[^/]+/([a-z][a-z])/', 1) AS class_name,
       CAST(bit_length(html) / 8 AS BIGINT) AS n_bytes
FROM {pages}
"""

# The pages as the files of an image folder (content, class folder, page).
PAGE_IMAGES_SQL = """
SELECT html AS value, regexp_extract(url, '^[a-z]+://[^/]+/([a-z][a-z])/', 1) AS class, page_id AS page
FROM {pages} WHERE html IS NOT NULL
"""

# Files of the datasets: every page is a file of one dataset (the brand names
# of the trials' datasets, dealt by page number; one brand has no file).
DATASET_FILES_SQL = """
SELECT 'Brand#' || CAST(1 + page_id % 22 AS STRING) AS dataset,
       CAST(bit_length(html) / 8 AS BIGINT) AS n_bytes
FROM {pages}
"""

# Validation split stand-in: files by name.
VAL_FILES_SQL = """
SELECT 'val_' || CAST(page_id AS STRING) || '.JPEG' AS file, url AS path, CAST(bit_length(html) / 8 AS BIGINT) AS n_bytes
FROM {pages}
"""

# Annotation lines in file order (ord, k).  Some files are listed twice (the
# last line tells), some lines lack the class.
ANNOTATION_SQL = """
SELECT ord, k, 'val_' || CAST(ord AS STRING) || '.JPEG' || tail AS line FROM (
  SELECT doc_id AS ord, 0 AS k, CASE WHEN doc_id % 7 = 3 THEN '' ELSE chr(9) || lang || chr(9) || '0' || chr(9) || '63' END AS tail FROM {documents}
  UNION ALL
  SELECT doc_id AS ord, 1 AS k, chr(9) || 'en' || chr(9) || '1' AS tail FROM {documents} WHERE doc_id % 5 = 0) AS a
"""

# Class list in file order: languages by their last document, which is not the
# order of their names; a blank line and a padded name belong to the file.
CLASS_LIST_SQL = """
SELECT ord, line FROM (
  SELECT -max(doc_id) AS ord, CASE WHEN lang = 'fr' THEN '  fr ' ELSE lang END AS line FROM {documents} WHERE lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT -min(doc_id) - 1 AS ord, '' AS line FROM {documents}) AS c
"""

# ---------------------------------------------------------------------------
# GPU specification dimension.
# Fixed values (fixture numbers): one GPU has no FP16, one has SM = 0, two
# have no total_vram_bytes; 'Mystery GPU' has no row at all.
# ---------------------------------------------------------------------------
GPU_SPEC_COLUMNS = ("gpu_name", "FP16", "FP32", "FP64", "mem_gb", "bw_gbs", "SM",
                    "total_vram_bytes", "mem_type", "bus", "gpu_arch")
GPU_SPEC_ROWS = (
    ("NVIDIA A100 80GB PCIe", 312.0, 19.5, 9.7, 80.0, 1935.0, 108.0, 85899345920.0, "HBM2e", "PCIe", "Ampere"),
    ("NVIDIA H100 PCIe", 756.0, 51.0, 26.0, 80.0, 2000.0, 114.0, 85899345920.0, "HBM2e", "PCIe", "Hopper"),
    ("NVIDIA L4", 121.0, 30.3, 0.49, 24.0, 300.0, 58.0, 25769803776.0, "GDDR6", "PCIe", "Ada"),
    ("NVIDIA L40S", 366.0, 91.6, 1.4, 48.0, 864.0, 142.0, None, "GDDR6", "PCIe", "Ada"),
    ("NVIDIA A40", 150.0, 37.4, 0.58, 48.0, 696.0, 84.0, 51539607552.0, "GDDR6", "PCIe", "Ampere"),
    ("NVIDIA GeForce RTX 5090", None, 104.8, 1.6, 32.0, 1792.0, 170.0, 34359738368.0, "GDDR7", "PCIe", "Blackwell"),
    ("NVIDIA RTX 4000 Ada Generation", 26.7, 26.7, 0.4, 20.0, 360.0, 0.0, None, "GDDR6", "PCIe", "Ada"),
    ("Tesla V100-SXM2-32GB", 125.0, 15.7, 7.8, 32.0, 900.0, 80.0, 34359738368.0, "HBM2", "SXM2", "Volta"),
    ("Tesla T4", 65.0, 8.1, 0.25, 16.0, 320.0, 40.0, 17179869184.0, "GDDR6", "PCIe", "Turing"),
)
GPU_SPEC_SCHEMA = T.StructType(
    [T.StructField("gpu_name", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType(), True) for c in GPU_SPEC_COLUMNS[1:8]]
    + [T.StructField(c, T.StringType(), True) for c in GPU_SPEC_COLUMNS[8:]])


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"CAST('{v!r}' AS DOUBLE)"


def gpu_spec_sql() -> str:
    """The dimension as an inline VALUES table (for the SQL oracle)."""
    rows = []
    for r in GPU_SPEC_ROWS:
        vals = [_sql_literal(r[0])]
        vals += [_sql_literal(v) if v is not None else "CAST(NULL AS DOUBLE)" for v in r[1:8]]
        vals += [_sql_literal(v) for v in r[8:]]
        rows.append("(" + ", ".join(vals) + ")")
    return ("SELECT * FROM (VALUES " + ",\n  ".join(rows) + ") AS s("
            + ", ".join(GPU_SPEC_COLUMNS) + ")")


def gpu_spec(spark: SparkSession) -> DataFrame:
    """The dimension as an in-JVM local relation (no Python-side RDD)."""
    return spark.sql(gpu_spec_sql())


def _view(spark: SparkSession, sf_dir: str, sql: str, tables) -> DataFrame:
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})


def raw_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RAW_TRIALS_SQL, ("lineitem", "part"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, STEPS_SQL, ("events",))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LAYERS_SQL, ("part",))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CORPUS_SQL, ("documents",))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PAIRS_SQL, ("conversations",))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PAGES_SQL, ("pages",))


def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, DATASET_FILES_SQL, ("pages",))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; its files go when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def annotation_file(spark: SparkSession, sf_dir: str) -> str:
    """Validation annotations written as text, in order; its path."""
    path = shared_path(spark, "annotations")
    _view(spark, sf_dir, ANNOTATION_SQL, ("documents",)).orderBy("ord", "k").select("line").write.text(path)
    return path


def class_list_file(spark: SparkSession, sf_dir: str) -> str:
    """The class list (the "wnids" file) written as text, in order; its path."""
    path = shared_path(spark, "classes")
    _view(spark, sf_dir, CLASS_LIST_SQL, ("documents",)).orderBy("ord").select("line").write.text(path)
    return path


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """The pages as files, one each, ``<root>/<class>/images/...``; the root.

    Spark's writer names folders ``column=value``; one file a page.  Hadoop's
    local file system starts several ``chmod`` processes a file, so in a shared
    folder that is mounted (``file:``) the tasks write the same layout themselves."""
    path = shared_path(spark, "images")
    pages = _view(spark, sf_dir, PAGE_IMAGES_SQL, ("pages",))
    if urlparse(path).scheme == "file":
        write_lines(pages, urlparse(path).path)
    else:
        pages.write.partitionBy("class", "page").option("maxRecordsPerFile", 1).text(path)
    return path


def write_lines(pages: DataFrame, root: str) -> int:
    """Every row's line as ``<root>/class=<class>/page=<page>/part-<n>.txt`` of a
    mounted folder; how many.

    A file appears whole, by a rename; a task that runs again writes the same names."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for number, value, *keys in zip(*(c.to_pylist() for c in b.columns)):
                folder = os.path.join(root, *(f"{k}={v}" for k, v in zip(("class", "page"), keys)))
                os.makedirs(folder, exist_ok=True)
                unfinished = os.path.join(folder, f".part-{number}-{uuid.uuid4().hex}")
                with open(unfinished, "wb") as f:
                    f.write(value + b"\n")
                os.replace(unfinished, os.path.join(folder, f"part-{number}.txt"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    os.makedirs(root, exist_ok=True)
    key = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = pages.select(F.monotonically_increasing_id().alias("number"), F.col("value").cast("binary").alias("value"), key("class").alias("class"), key("page").alias("page"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]


def val_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, VAL_FILES_SQL, ("pages",))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class list read back from its file."""
    from .manifest import class_list
    return class_list(spark, class_list_file(spark, sf_dir))


def duckdb_view(sql: str) -> str:
    """The same view text for DuckDB, where tables are registered by name."""
    names = ("lineitem", "part", "events", "documents", "conversations", "pages",
             "labels", "orders", "supplier", "customer", "nation", "region",
             "benchmark", "embeddings")
    return sql.format(**{n: n for n in names})
