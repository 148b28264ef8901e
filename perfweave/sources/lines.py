"""Text files whose line order matters (class lists, annotation files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos): the lines of a file, or of a folder's files by name, with a
    value that sorts like their order.

    Spark splits large files.  A line's place is (file, start of its split,
    number inside the partition that reads the split), so no file is held in
    one row, no matter how long it is.
    """
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                   F.monotonically_increasing_id().alias("number"))
    return spark.read.text(path).select(F.col("value").alias("line"), pos.alias("pos"))
