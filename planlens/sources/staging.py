"""Intermediate tables in the folder that all executors share, so that lost executors cost no long recomputation.

``materialise`` writes a table that one call needs. ``staged`` writes a table that several calls need once for its content: a stage is
known by its name, what it is made with, and the fingerprints of its inputs (path, files, bytes and time of change), so it is
written anew if an input changes, or if its files are gone. ``close`` deletes what a session has written; it runs by itself when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a finished write, whose rows are safe in the shared folder, under this setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: By application: the tables that are there, and the stages by their key.
_STORED: dict[str, set[str]] = {}
_STAGES: dict[str, dict[str, DataFrame]] = {}
_SESSIONS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. ``spark.checkpoint.dir`` names it on a cluster; a temporary one serves local tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = os.path.join(tempfile.gettempdir(), "planlens-shared")
    os.makedirs(made, exist_ok=True)
    return made


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, set()).add(path)
    _SESSIONS[spark.sparkContext.applicationId] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and later plans read only the columns they need."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def _file_system(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _there(spark: SparkSession, path: str) -> bool:
    fs, found = _file_system(spark, path)
    return fs.exists(found)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more: what came of them is in later tables of the shared folder."""
    for t in tables:
        fs, path = _file_system(t.sparkSession, t.stored)
        fs.delete(path, True)
        _STORED.get(t.sparkSession.sparkContext.applicationId, set()).discard(t.stored)


def fingerprint(spark: SparkSession, path: str) -> str:
    """The path with its number of files, bytes and time of change: one look at the folder, no file is read."""
    fs, found = _file_system(spark, path)
    size = fs.getContentSummary(found)
    return f"{path}:{size.getFileCount()}:{size.getLength()}:{fs.getFileStatus(found).getModificationTime()}"


def staged(spark: SparkSession, name: str, inputs: list[str], made_with: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of ``inputs``, written by the first call that asks for it and read by all others of the session."""
    own = _STAGES.setdefault(spark.sparkContext.applicationId, {})
    key = hashlib.sha256("\n".join([name, made_with, *(fingerprint(spark, p) for p in inputs)]).encode()).hexdigest()
    if key not in own or not _there(spark, own[key].stored):
        own[key] = materialise(build(), name)
    return own[key]


def close(spark: SparkSession) -> None:
    """Delete every table that this application has written here and not deleted yet. What reads them must be done."""
    app = spark.sparkContext.applicationId
    for path in _STORED.pop(app, set()):
        fs, found = _file_system(spark, path)
        fs.delete(found, True)
    _STAGES.pop(app, None)
    _SESSIONS.pop(app, None)


@atexit.register
def _close_all() -> None:
    for spark in list(_SESSIONS.values()):
        with contextlib.suppress(Exception):  # Spark may be gone already
            close(spark)
