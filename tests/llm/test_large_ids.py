"""Ids above 2^53 beside a null: as doubles they would be changed without a word."""

import pytest
from pyspark.sql import functions as F

from planlens.llm import decontaminate, mixing, ngrams, pages, pii, simhash, simhash_similar, substrings, toxicity

IDS = [9007199254740993, 9007199254740995, 9223372036854775807, -9223372036854775807, None]
ITEM = "an item of the benchmark that some of the texts hold word for word"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {n} with words of its own x{n} y{n} z{n} {ITEM}", "s", i) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").coalesce(1)


OPERATORS = {
    "score": lambda d: toxicity.score(d, toxicity.NoisyOrModel(-3.0, {})),
    "reject": lambda d: toxicity.reject(d, toxicity.NoisyOrModel(-9.0, {})),
    "near_duplicates": simhash.near_duplicates,
    "similar_classes": simhash_similar.similar_classes,
    "keep_first": simhash_similar.keep_first,
    "remove_repeats": substrings.remove_repeats,
    "contaminated": lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame([(1, ITEM)], "item_id long, text string")),
    "clean": lambda d: decontaminate.clean(d, d.sparkSession.createDataFrame([(1, "not in any of these texts at all")], "item_id long, text string")),
    "mix": mixing.mix,
    "ngrams": ngrams.score,
    "find": lambda d: pii.find(d, pii.fit(pii.labelled_rows(), rounds=2)),
    "redact": lambda d: pii.redact(d, pii.fit(pii.labelled_rows(), rounds=2)),
    "pages": lambda d: pages.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"))).withColumnRenamed("page_id", "doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_are_kept(name, docs):
    got = [r.doc_id for r in OPERATORS[name](docs).select("doc_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, IDS))


def test_component_item_and_passed_columns(spark, docs):
    same = docs.withColumn("text", F.lit(ITEM))
    for f in (simhash.near_duplicates, simhash_similar.similar_classes):
        assert {r.component_id for r in f(same).collect()} == {min(i for i in IDS if i is not None)}
    items = spark.createDataFrame([(i, ITEM) for i in IDS], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in got) == sorted(str((a, b)) for a in IDS for b in IDS)
    model = toxicity.NoisyOrModel(-9.0, {})
    assert sorted(str(r.n_chars) for r in toxicity.reject(docs, model).collect()) == sorted(map(str, IDS))
