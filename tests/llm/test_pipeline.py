"""The registered queries, and each stage of the pipeline on its own input."""

import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from planlens.llm import decontaminate, pii, registry, toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        before, docs = docs, spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        steps[name] = (before, docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert steps[n][1].columns == steps[n][0].columns

    before, after = steps[names[0]]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if model.score(model.sentence_logits(r.text)[0]) < 0.3}

    before, after = steps[names[1]]
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()) for r in before.collect()}
    sh = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    kept = {r.doc_id for r in after.collect()}
    similar = lambda a, b: len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])
    assert all(any(similar(d, k) for k in words if k != d) for d in words.keys() - kept)  # no document without a copy goes
    assert not [(a, b) for a in kept for b in kept if a < b and similar(a, b)]

    before, after = steps[names[2]]
    items = [(r.item_id, decontaminate.normalised(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before.collect() if any(decontaminate.myers(t, decontaminate.normalised(r.text), int(0.08 * len(t))) <= int(0.08 * len(t)) for _, t in items if len(t) >= 24)}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - dirty

    before, after = steps[names[3]]
    assert before.count() == after.count()
    assert not any(v for r in after.collect() for v in pii.base_spans(r.text or "").values())

    before, after = steps[names[4]]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in before.collect()}
    assert all(r.size == size[r.doc_id] and r.taken == r.copies * r.size and 1 <= r.copies <= 2 for r in after.collect())
    total = sum(size.values())
    assert abs(sum(r.taken for r in after.collect()) - min(1.5, 2) * total) <= 0.05 * total


def test_stages_on_odd_tables(spark, odd_docs, no_docs, tmp_path):
    for i, table in enumerate((odd_docs, no_docs)):
        docs = table
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{i}-{j}"))
            docs = spark.read.parquet(str(tmp_path / f"{i}-{j}"))
            assert set(table.columns) <= set(docs.columns)
