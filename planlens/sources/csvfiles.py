"""CSV files by header name, however many there are and whatever the order of their columns.

Only the first line of each file is looked at beforehand. Files with the same header are read together by position under their
own names, and the groups are united by name, so a folder whose files list their columns in another order, or have some
more, is one table.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: A header longer than this is refused.
HEADER_BYTES = 1 << 20


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files under a path, a folder or a pattern, as Spark would list them: names that start with a dot or underscore are no data."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for found in fs.globStatus(hadoop(path)) or []:
        listed = fs.listFiles(found.getPath(), True)
        while listed.hasNext():
            one = listed.next().getPath()
            if not one.getName().startswith((".", "_")):
                out.append(one.toString())
    return sorted(out)


def header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in the first line of a file, without a byte-order mark; none if it is empty."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    line = (line or "").lstrip("﻿").rstrip("\r")
    if len(line) > HEADER_BYTES:
        raise ValueError(f"the first line of {path} is no header")
    return tuple(n.strip() for n in next(csv.reader([line], skipinitialspace=True))) if line.strip() else ()


def read_csv(spark: SparkSession, path: str, headers: tuple[str, ...] | list[str], corrupt: str | None = None) -> DataFrame:
    """All columns as strings, by header name: ``headers`` first, then what else any file has, null where a file lacks it.

    Raises if there is no file, or one is empty, lacks one of ``headers`` or has a name twice. With ``corrupt``, a column of that name
    holds the line of a row that has not as many cells as its file has columns, and is null in all others.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for f in _files(spark, path):
        groups.setdefault(header(spark, f), []).append(f)
    if not groups:
        raise ValueError(f"no file at {path}")
    read = spark.read.option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"')
    frames = []
    for names, files in sorted(groups.items()):
        if not names:
            raise ValueError(f"{files[0]} is empty")
        if missing := [h for h in headers if h not in names]:
            raise ValueError(f"{files[0]} lacks the headers {', '.join(missing)}")
        if len(set(names)) < len(names):
            raise ValueError(f"{files[0]} has a header twice")
        fields = [StructField(n, StringType()) for n in names]
        if corrupt:
            fields.append(StructField(corrupt, StringType()))
            read = read.option("columnNameOfCorruptRecord", corrupt)
        frames.append(read.schema(StructType(fields)).csv(files))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.select(*headers, *(n for n in both.columns if n not in headers))


def faulty(rows: DataFrame, corrupt: str) -> DataFrame:
    """The lines with too few or too many cells, of what ``read_csv`` gave with ``corrupt``."""
    return rows.where(F.col(corrupt).isNotNull()).select(F.col(corrupt).alias("line"))
