"""A store of loaded records in which a load is all there or not there at all.

A load writes the parents, their type rows and the batch headers of its years to folders of its own, which no reader looks at.
The gate then decides on what was written. Publishing is one rename of a manifest, a small file that lists the load's years;
readers start from the manifests. So a load that fails on the way, in any task or by the gate, leaves nothing that is seen, and
``sweep`` removes its files. Loads don't touch each other's folders, and a year that was loaded from the same content by the same
importer is skipped.

    root/manifests/<load>.json         a line for each year: the header of its batch
    root/records/load=<load>/dataset_year=<year>/...
    root/types/load=<load>/dataset_year=<year>/...
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from planlens.sources import ingest

KEY = ("dataset_year", "source_sheet", "source_row")
HEADER = "dataset_year int, source_sha256 string, canonical_sha256 string, importer_version string, source_file_name string, total_rows long, valid_rows long, missing_rows long, suspect_rows long, status string, load string"


def _fs(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _exists(spark: SparkSession, path: str) -> bool:
    fs, found = _fs(spark, path)
    return fs.exists(found)


def _publish(spark: SparkSession, root: str, load: str, lines: list[str]) -> None:
    """The manifest appears under its name when it is complete: written aside, then renamed."""
    fs, draft = _fs(spark, f"{root}/_drafts/{load}.json")
    _, manifest = _fs(spark, f"{root}/manifests/{load}.json")
    out = fs.create(draft, True)
    try:
        out.write(bytearray("\n".join(lines).encode()))
    finally:
        out.close()
    fs.mkdirs(manifest.getParent())
    if not fs.rename(draft, manifest):
        raise RuntimeError(f"could not publish {manifest}")


def batches(spark: SparkSession, root: str) -> DataFrame:
    """The headers of all published batches."""
    if not _exists(spark, f"{root}/manifests"):
        return spark.createDataFrame([], HEADER)
    return spark.read.schema(HEADER).json(f"{root}/manifests")


def _published(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Rows of published loads. Load and year are folders, so only those that a manifest lists are read."""
    there = F.broadcast(batches(spark, root).select("load", "dataset_year"))
    return spark.read.parquet(f"{root}/{kind}").join(there, ["load", "dataset_year"])


def records(spark: SparkSession, root: str) -> DataFrame:
    return _published(spark, root, "records")


def types(spark: SparkSession, root: str) -> DataFrame:
    return _published(spark, root, "types")


def load(rows: DataFrame, root: str, file_name: str, canonical_sha256: str, importer_version: str, gate: Callable[[DataFrame, dict[str, int]], None] | None = None) -> dict[int, str]:
    """Loads canonical rows without a fatal issue; gives IMPORTED or ALREADY_IMPORTED for each year.

    ``gate`` is called with the rows as they were written and with what the write itself has seen (rows read, fatal ones, issues),
    before anything is published, and stops the load by raising. Rows are
    dealt out so that a year's files are of even size whatever its number of rows. Headers are counted from what was written.
    """
    spark, name = rows.sparkSession, uuid.uuid4().hex
    good, of = ingest.accepted(rows), ["source_sha256", "canonical_sha256", "importer_version"]
    asked = good.groupBy("dataset_year").agg(F.min("source_sha256").alias("source_sha256")).withColumns({"canonical_sha256": F.lit(canonical_sha256), "importer_version": F.lit(importer_version)})
    asked = asked.join(F.broadcast(batches(spark, root).select("dataset_year", *of, F.lit(True).alias("known"))), ["dataset_year", *of], "left")
    state = {r["dataset_year"]: "ALREADY_IMPORTED" if r["known"] else "IMPORTED" for r in asked.collect()}
    new = [y for y, s in state.items() if s == "IMPORTED"]
    if not new:
        return state
    seen = Observation("load")
    watched = rows.observe(seen, F.count("*").alias("rows"), F.count_if(F.exists("issues", lambda i: i["fatal"])).alias("fatal_rows"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("issues"))
    fresh = ingest.accepted(watched).where(F.col("dataset_year").isin(new))
    fresh.hint("rebalance", "dataset_year").write.partitionBy("dataset_year").parquet(f"{root}/records/load={name}")
    written = spark.read.parquet(f"{root}/records/load={name}")
    if gate:
        gate(written, seen.get)
    ingest.type_rows(written, list(KEY)).hint("rebalance", "dataset_year").write.partitionBy("dataset_year").parquet(f"{root}/types/load={name}")
    headers = ingest.batch_headers(written, file_name, canonical_sha256, importer_version).withColumn("load", F.lit(name))
    _publish(spark, root, name, [json.dumps(r.asDict()) for r in headers.collect()])
    return state


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Deletes the files of loads that were never published and gives their names. No load may run meanwhile."""
    known, gone = {r["load"] for r in batches(spark, root).select("load").distinct().collect()}, set()
    for kind in ("records", "types"):
        fs, top = _fs(spark, f"{root}/{kind}")
        for s in fs.listStatus(top) if fs.exists(top) else []:
            name = s.getPath().getName().removeprefix("load=")
            if s.isDirectory() and name not in known:
                fs.delete(s.getPath(), True)
                gone.add(name)
    return sorted(gone)
