"""Fill-in-the-middle against regular expressions over whole texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlens.llm import fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def expected(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text, text
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    out, form = (f"<S>{suf}<P>{pre}<M>{mid}", "spm") if h4 % 100 < 20 else (f"<P>{pre}<S>{suf}<M>{mid}", "psm")
    return doc_id, len(tokens), form, len(pre), len(mid), out, text


def cases():
    rng = random.Random(5)
    pool = ["a", "bc", "P", "S", "M", "<", ">", "<P", "S>", "<M>", " ", "\n", "é", "東", "𝔘", "1", "-", "\x00"]
    texts = ["".join(rng.choice(pool[:9] + pool[10:]) for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    texts += ["", None, "w" * 5000, "é" * 700, "x" * 255 + "<" + "P>", "y" * 254 + "<P>", "z" * 256 + "<M" + ">" * 3, "<<P>", "<P<P", " " * 600, "<PS>", "ab <S> cd"]
    rows = list(enumerate(texts)) + [(None, "no id " * 90), (7, texts[7]), (7, texts[7]), (-3, "below zero"), (9007199254740993, "w x y")]
    return rows + [(1000 + i, "the same giant " * 60) for i in range(50)]


@pytest.mark.parametrize("piece", [1 << 16, 300, 7])
def test_every_cut_and_every_text_back(spark, piece):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "a", "b", "key", "bytes", "h1", "form", "cut", "at")})
    out = fim.transform(docs, piece=piece).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.where("false"), piece=piece).count() == 0


def test_functions_compose_however_a_text_is_cut():
    rng = random.Random(9)
    for _ in range(50):
        text = "".join(rng.choice("aP<>é1 ") for _ in range(rng.randrange(1, 900))).encode()
        whole, at, state, starts, marks = fim.Scan([text]), 0, 0, 0, 0
        while at < len(text):
            size = rng.randrange(1, 300)
            part = fim.Scan([text[at : at + size]])
            starts, marks, state, at = starts + part.starts[0, state], marks + part.marks[0, state], part.to[0, state], at + size
        assert (whole.to[0, 0], whole.starts[0, 0], whole.marks[0, 0]) == (state, starts, marks)
        bounds = [len(m.group().encode()) for m in TOKEN.finditer(text.decode())]
        want = np.concatenate([np.cumsum([0, *bounds])])
        n = len(bounds)
        assert (whole.places(np.zeros(n + 1, int), np.zeros(n + 1, int), np.arange(n + 1)) == want).all()


def test_copies_of_a_giant_are_one_set_of_pieces(spark, monkeypatch):
    """Thousands of copies of a text of many pieces: the functions are of each piece once."""
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('some words, and more; ', 40) text")
    seen = []

    def watched(groups, function, schema, session, real=fim.grouped):
        out = real(groups, function, schema, session)
        seen.append(out)
        return out

    monkeypatch.setattr(fim, "grouped", watched)
    out = fim.transform(docs, piece=100)
    assert seen[0].count() == 9
    assert out.count() == 3000 and out.select("n").distinct().count() == 1
