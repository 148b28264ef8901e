"""Spark session and checkpoint-directory helpers.

On a cluster the session is created by the launcher; the library only reads
its settings.  ``local_session`` is for tests and the bench script.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in the library is written for: AQE re-plans joins with
# runtime sizes (the size check behind every non-literal broadcast), coalesces
# small shuffle partitions and splits skewed join partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "perfweave", extra: dict | None = None) -> SparkSession:
    """Single-JVM session for tests / bench (the web UI stays off)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only a local-mode session (tests) without one gets
    a fresh scratch folder.  A non-local session without the setting is an
    error: a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="perfweave-ckpt-"))
    return sc.getCheckpointDir()


def code_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it
    (a path all machines see; elsewhere the package goes with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def jit_sized_methods(spark: SparkSession) -> None:
    """Let Spark split generated methods that the JVM would only interpret.

    HotSpot compiles no method beyond 8,000 bytes of bytecode; Spark's own limit
    for falling back to split code is 65,535.  Between the two a wide projection runs
    interpreted, several times slower.  A setting of the session stays.
    """
    name, default = "spark.sql.codegen.hugeMethodLimit", "65535"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, "8000")
