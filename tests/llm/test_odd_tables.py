"""Every operator on the awkward table and on an empty one: a row for each document where that is the contract, no crash."""

import pytest

from planlens.llm import decontaminate, fim, minmax, mixing, ngrams, pii, simhash, simhash_similar, substrings, toxicity

PER_DOCUMENT = {
    "toxicity": lambda d: toxicity.score(d, toxicity.NoisyOrModel(-3.0, {"fox": 2.0})),
    "simhash": simhash.near_duplicates,
    "simhash_similar": simhash_similar.similar_classes,
    "substrings": substrings.remove_repeats,
    "mixing": mixing.mix,
    "ngrams": ngrams.score,
    "fim": fim.transform,
    "minmax": minmax.near_duplicates,
    "pii": lambda d: pii.find(d, pii.fit(pii.labelled_rows(), rounds=5)),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(name, odd_docs, no_docs):
    got = PER_DOCUMENT[name](odd_docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())
    assert PER_DOCUMENT[name](no_docs).count() == 0


def test_filters_keep_all_columns_of_clean_documents(spark, odd_docs, no_docs):
    model, field = toxicity.NoisyOrModel(-9.0, {}), pii.fit(pii.labelled_rows(), rounds=5)
    items = spark.createDataFrame([(1, "nothing of the kind is in here anywhere"), (None, None), (2, "")], "item_id long, text string")
    for f in (lambda d: toxicity.reject(d, model), lambda d: decontaminate.clean(d, items), lambda d: pii.redact(d, field)):
        for docs in (odd_docs, no_docs):
            out = f(docs)
            assert out.columns == docs.columns and out.count() == docs.count()
    kept = simhash_similar.keep_first(odd_docs)
    # the repeated row goes; null, empty and blank texts are copies of each other
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "None"]


def test_training_without_usable_labels(spark, odd_docs):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()} <= {0.0} | {r.score for r in toxicity.score(odd_docs, toxicity.NoisyOrModel()).collect()}
