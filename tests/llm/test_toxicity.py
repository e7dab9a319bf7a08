"""Noisy-or: the formula, the located sentence, and held-out accuracy on the given tables."""

import math
import os
import re
import tracemalloc
import zlib

import pytest

from planlens.llm import registry, toxicity

SF = "/root/testdata/sf0.01"


def test_noisy_or_against_the_plain_product():
    model = toxicity.NoisyOrModel(-2.0, {"bad": 3.0, "worse": 4.0, "^wors": 0.5})
    logits, spans = model.sentence_logits("All is well. This is bad! Even worse things\nok")
    want = [-2.0, 1.0, 2.5, -2.0]
    assert logits == pytest.approx(want)
    clean = math.prod(1 - 1 / (1 + math.exp(-z)) for z in want)
    assert model.score(logits) == pytest.approx(1 - clean)
    assert model.score([]) == 0.0 and len(spans) == 4


def test_sentences_are_located_from_document_labels(spark):
    clean = "the sky is {0} blue"
    texts, labels = [], []
    for i in range(60):
        body = [clean.format(x) for x in ("very", "quite", "rather", "so")[: 1 + i % 4]]
        if i % 3 == 0:
            body.insert(i % 2, "you are a grumblefink today")
        texts.append(". ".join(body) + ".")
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        assert r.predicted == labels[r.doc_id]
        found = [texts[r.doc_id][s.start : s.end] for s in r.toxic_sentences]
        assert all("grumblefink" in s for s in found) and bool(found) == bool(labels[r.doc_id])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    scores = {r.doc_id: r for r in registry.op1_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()
    held = [(scores[r.doc_id].predicted, r.toxic, scores[r.doc_id].score) for r in labels if r.doc_id in scores and scores[r.doc_id].held_out]
    assert sum(p == y for p, y, _ in held) / len(held) >= 0.9
    bad, good = [s for _, y, s in held if y], [s for _, y, s in held if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good)) >= 0.9


def test_the_query_row_by_row(spark):
    """Every document of the smallest tables: its fold by plain CRC, its score by a plain product over sentences, and the decision."""
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in registry.op1_toxicity(spark, small).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, text in rows:
        clean = 1.0
        for sentence in re.split(r"[.!?\n]+", text or ""):
            words = set(re.findall(r"[^\W_]+", sentence.lower()))
            if words:
                z = model.bias + sum(model.weights.get(f, 0.0) for f in words | {"^" + w[:4] for w in words if len(w) > 4})
                clean *= 1 - 1 / (1 + math.exp(-z))
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and r.predicted == int(r.score >= 0.3)


def test_the_fit_holds_numbers_not_objects_for_each_sentence():
    words = [f"word{i:04d}x" for i in range(500)]
    texts = [". ".join(" ".join(words[(7 * n + 11 * i + k) % 500] for k in range(6)) for i in range(300)) for n in range(200)]
    tracemalloc.start()
    toxicity.fit(texts, [n % 2 for n in range(200)], rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    features = 7 * 300 * 200  # six words of a sentence and the beginning they share
    assert peak < 50 * features
