"""CSV trial files read by column name.

Every generator run writes its own file, and files differ in their columns
and in their order.  The header line of each file is read once (as a Parquet
reader reads footers); files with the same header form one reader with a typed
schema in that order, and the readers are united by name.  A line that does
not fit its header, or a value that is not of its column's type, puts the
whole line in quarantine instead of turning into nulls.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
MAX_HEADER = 1 << 20  # characters of a header line


def csv_paths(spark: SparkSession, path: str) -> list[str]:
    """Data files at or below a path, hidden ones left out, by name."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], list(fs.globStatus(root) or [])
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        s = todo.pop()
        if s.getPath().getName().startswith(("_", ".")):
            continue
        if s.isDirectory():
            todo += list(fs.listStatus(s.getPath()))
        elif s.getLen() > 0:
            out.append(s.getPath().toString())
    return sorted(out)


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in the first line of a file (compressed files too)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        plain = codec.createInputStream(stream) if codec is not None else stream
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()
    if line is None or len(line) > MAX_HEADER:
        raise ValueError(f"no header line in {path}")
    return tuple(c.strip() for c in next(csv.reader(io.StringIO(line.lstrip("﻿"))), []))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of the CSV files at or below ``path``.

    ``schema`` gives the types of the columns it names; a column it does not
    know is read as text, a column that no file has is null.  ``quarantine``
    holds (file, line) of every line that was not read.  Of a header's repeated
    names the first counts.
    """
    known = {f.name: f.dataType for f in schema.fields}
    groups = defaultdict(list)
    for p in csv_paths(spark, path):
        groups[header(spark, p)].append(p)
    rows, broken = [], []
    for names, paths in sorted(groups.items()):
        seen: set = set()
        fields = [T.StructField(n if not (n in seen or seen.add(n)) else f"__again_{i}", known.get(n, T.StringType()))
                  for i, n in enumerate(names)]
        again = [f.name for f in fields if f.name.startswith("__again_")]
        read = (spark.read.schema(T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]))
                .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
                .csv(paths))
        # Spark converts only the columns that a plan reads.  A condition that always holds reads all of them,
        # so that a line is whole or broken whatever columns are asked for.
        every = F.hash(*[F.col(f.name) for f in fields]) >= F.lit(-(1 << 31))
        rows.append(read.where(every & F.col(CORRUPT).isNull()).drop(CORRUPT, *again))
        broken.append(read.where(every & F.col(CORRUPT).isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("line")))
    if not rows:
        return spark.createDataFrame([], schema), spark.createDataFrame([], "file string, line string")
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    union = union.withColumns({n: F.lit(None).cast(t) for n, t in known.items() if n not in union.columns})
    order = [*[n for n in known], *[c for c in union.columns if c not in known]]
    return union.select(*order), reduce(DataFrame.unionByName, broken)
