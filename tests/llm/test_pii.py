"""Base spans against the plain patterns; Viterbi against all label sequences; what the field adds and what is redacted."""

import hashlib
import itertools
import random
import re

import numpy as np

from planlens.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    total = 0
    for i, x in enumerate(reversed(d)):
        x = int(x) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = "".join(c for c in m[0] if c in "0123456789")
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and plain_luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out[kind].append(m.span())
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(7)
    parts = ["4418 4525 2484 2581", "371449635398431", "1.2.3.4", "256.1.1.1", "0001.02.3.4", "a@b.c", "a@b@c.d", "@", ".", "..", "-", "+", "+1 (986) 555-4218", "+49", " ", "x", "7", "12", "é", "٣", "(", ")", "%", "_", "\n", "00000000000000"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 9)))
        assert pii.base_spans(t) == plain(t), t


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(3)
    model = pii.fit(pii.labelled_rows(), rounds=10)
    model.trans[:] = rng.normal(size=model.trans.shape)
    seqs = [["call", "+1", "(986)", "555-4218"], ["a@b.c"], ["x", "1.2.3.4", "y"], [], ["5", "6", "7", "8", "9"]]
    for words, got in zip(seqs, model.decode(seqs, batch_words=9)):
        if words:
            em, n = model.emissions(words), len(words)
            score = lambda s, em=em, n=n: sum(em[i, s[i]] for i in range(n)) + sum(model.trans[a, b] for a, b in itertools.pairwise(s))
            best = max(itertools.product(range(len(pii.LABELS)), repeat=n), key=score)
            assert np.isclose(score(got.tolist()), score(best))


def test_training_fits_its_table_and_adds_spans(spark):
    model = pii.train(pii.labelled_table(spark))
    rows = pii.labelled_rows()
    right = total = 0
    for (_, labels), got in zip(rows, model.decode([w for w, _ in rows])):
        right += sum(pii.LABELS[g] == x for g, x in zip(got.tolist(), labels))
        total += len(labels)
    assert right >= 0.97 * total
    text = "please call (216) 555-1810 today or mail jane@example.org, in 1998 for 12 items"
    base, both = pii.all_spans([text], model)[0]
    assert base["phone"] == [] and [text[a:b] for a, b in both["phone"]] == ["(216) 555-1810"]
    assert [text[a:b] for a, b in both["email"]] == ["jane@example.org"] and not both["card"] and not both["ip"]
    docs = spark.createDataFrame([(1, text, 1), (2, None, None), (3, "clean text", 10)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs, model).collect()}
    want = text.replace("(216) 555-1810", "<PHONE>").replace("jane@example.org", "<EMAIL>")
    assert got == {1: (want, len(want)), 2: (None, None), 3: ("clean text", 10)}


def test_the_query_row_by_row(spark):
    """Counts and digest of the base spans against the plain patterns on a whole table; all spans hold them, and none that is added meets one."""
    model = pii.train(pii.labelled_table(spark))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (None, "4418452524842581 4418452524842581 or a@b.c and 1.2.3.4")], docs.schema))
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    for d, text in docs.collect():
        want = plain(text or "")
        base = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in sorted(want[k]))
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in r.spans.split(",") if x]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1])) and set(base.split(",")) - {""} <= set(r.spans.split(","))
        kept = [s for v in want.values() for s in v]
        assert all((a, b) in want[k] or not any(x < b and a < y for x, y in kept) for k, a, b in spans)
        assert r.n_added == len(spans) - len(kept)


def test_many_spans_in_one_text():
    """The search for spans that meet is not quadratic: 40,000 spans take a moment."""
    model = pii.fit(pii.labelled_rows(), rounds=20)
    text = "mail a@b.c or 555-1810 now " * 20_000
    base, both = pii.all_spans([text], model)[0]
    assert len(base["email"]) == 20_000 and len(both["email"]) == 20_000
