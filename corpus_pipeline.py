"""The corpus pipeline: rejects toxic documents, near copies and benchmark leaks, redacts personal data, then mixes sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.llm import decontaminate, mixing, pii, simhash_similar, toxicity
from planlens.llm.common import discard, materialise, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.3 or more go."""
    return toxicity.reject(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: SimHash links, and an exact join for the rest, of a similarity of 0.8 or more on shingles of five words."""
    return simhash_similar.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes a mark of its kind."""
    return pii.redact(docs, pii.train(pii.labelled_table(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their columns, size, source_size, target, copies and taken.

    Documents that it takes no copy of are not in it. Rows repeated in id, source and text are one row with the copies of
    all. A column of the input with the name of one that the mix adds gives way to it.
    """
    key = F.xxhash64("doc_id", "source", "text").alias("__key")
    mixed = mixing.mix(docs.select(key.alias("doc_id"), "source", "text")).where("copies > 0")
    taken = mixed.groupBy(F.col("doc_id").alias("__key")).agg(F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    return docs.drop(*taken.columns).select("*", key).dropDuplicates(["__key"]).join(taken, "__key").drop("__key")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The stages hold trained models, edit distances and seeded draws, which SQL does not express; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents."""
    docs, stored = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*stored)
        stored = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
