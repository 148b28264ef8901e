"""Image-folder and validation manifests.

A manifest is ``(path, label_idx, n_bytes)``.  File listings come from the
``binaryFile`` source with the ``content`` column pruned (only metadata is
read), so listing a billion files never reads their bytes.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .lines import ordered_lines

# Accepted image extensions (case-insensitive).
IMAGE_EXTENSIONS = (".jpeg", ".jpg", ".png")


def extension_filter(path_col: str, extensions) -> F.Column:
    ext = "|".join(e.lstrip(".").replace(".", r"\.") for e in extensions)
    return F.lower(F.col(path_col)).rlike(rf"\.({ext})$")


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Folders are listed in a few tasks a core, not in one task a folder (up to
    10,000 for every parent).  A setting of the session stays."""
    name, default = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"
    before = spark.conf.get(name, default)
    if before == default:
        spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before == default:
            spark.conf.unset(name)


def list_files(spark: SparkSession, root: str, extensions, class_pattern: str) -> DataFrame:
    """(path, n_bytes, class_name) of the files below ``root`` with an accepted
    extension; the pattern's group of the path is the class."""
    with few_listing_tasks(spark):  # ``load`` lists
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select("path", F.col("length").alias("n_bytes"))
    files = files.where(extension_filter("path", extensions))
    return files.withColumn("class_name", F.regexp_extract("path", class_pattern, 1))


def list_image_folder(spark: SparkSession, root: str, extensions=IMAGE_EXTENSIONS) -> DataFrame:
    """(path, n_bytes, class_name) for ``root/<class>/images/<file>``."""
    return list_files(spark, root, extensions, r"/([^/]+)/images/[^/]+$")


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """(class_name, pos) of a class list file: one name a line, blank lines skipped."""
    lines = ordered_lines(spark, path).select(F.regexp_replace("line", r"^\s+|\s+$", "").alias("class_name"), "pos")
    return lines.where("class_name <> ''")


def class_index(classes: DataFrame, name: str = "class_name") -> DataFrame:
    """Label index = position of the class in its list (W2); a class that is
    listed again takes its last position.

    The window runs over the class list only (one row per class).
    """
    at = classes.select(name, (F.row_number().over(Window.orderBy("pos")) - 1).cast("int").alias("label_idx"))
    return at.groupBy(name).agg(F.max("label_idx").alias("label_idx"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, class_name) of a tab-separated annotation file (S7): the first two
    fields; lines with fewer are skipped, the last line of a file name wins."""
    parts = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), "\t")
    lines = ordered_lines(spark, path).select(parts.alias("p"), "pos").where(F.size("p") >= 2)
    return lines.groupBy(F.get("p", F.lit(0)).alias("file")).agg(F.max_by(F.get("p", F.lit(1)), "pos").alias("class_name"))


def manifest(files: DataFrame, classes: DataFrame, extensions=None) -> DataFrame:
    """Files of known classes with their label index."""
    if extensions:
        files = files.where(extension_filter("path", extensions))
    idx = bounded_broadcast(class_index(classes))
    return files.join(idx, "class_name", "inner").select("path", "label_idx", "n_bytes")


def validation_manifest(files: DataFrame, mapping: DataFrame, classes: DataFrame,
                        key: str = "file", extensions=None) -> DataFrame:
    """Validation files with an accepted extension, mapped to a class by a
    file->class table; unmapped files are dropped (S7, J2)."""
    if extensions:
        files = files.where(extension_filter("path", extensions))
    idx = bounded_broadcast(class_index(classes))
    return (files.join(mapping, key, "inner").join(idx, "class_name", "inner")
                 .select("path", "label_idx", "n_bytes"))


def dataset_bytes(files: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Mean bytes per sample of every dataset."""
    return files.groupBy(dataset).agg(F.avg("n_bytes").alias("disk_bytes_per_sample"))


def with_dataset_bytes(trials: DataFrame, files: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Trials with their dataset's mean bytes; a dataset without files -> 0.0."""
    per = bounded_broadcast(dataset_bytes(files, dataset))
    return trials.join(per, dataset, "left").withColumn(
        "disk_bytes_per_sample", F.coalesce("disk_bytes_per_sample", F.lit(0.0)))


def average_bytes(man: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean bytes per sample of every class; a class without files -> 0.0."""
    per = man.groupBy("label_idx").agg(F.avg("n_bytes").alias("avg_bytes"))
    return (class_index(classes).join(per, "label_idx", "left")
            .select("class_name", "label_idx", F.coalesce("avg_bytes", F.lit(0.0)).alias("avg_bytes")))
