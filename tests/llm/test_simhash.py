"""Fingerprints, links and classes against brute force; near copies against the exact shingle similarity."""

import random
import re

import xxhash

from planlens.llm import simhash, simhash_similar


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, "One"), (9004, "one"), (9005, "É a B\x0bc")], "doc_id long, text string"))
    prints = {r.doc_id: plain_print(r.text) for r in docs.collect()}
    want = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_links_of_crowded_variants(spark):
    """Small and large buckets give the components that all links of two bits or fewer give."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:20]:
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                q ^= 1 << b
            prints.add(q)
    crowd = rng.getrandbits(64)
    prints |= {crowd ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(120)}
    prints = {signed(p) for p in prints}
    want = classes(prints, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for bucket in (2, 8, 1000):
        found = {(r.a, r.b) for r in simhash.links(df, bucket).collect()}
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and a < b for a, b in found)
        assert classes(prints, lambda a, b, found=found: (a, b) in found) == want


def test_near_copies_by_exact_similarity(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.choice([60, 200, 400]))]
        rows.append((n, " ".join(base)))
        for k in range(3):
            other = list(base)
            for _ in range(k * len(base) // 100):
                other[rng.randrange(len(other))] = word()
            n += 1
            rows.append((n, " ".join(other)))
        n += 1
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    want = classes(shingles, lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]))
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(want[d] == want[c] for d, c in got.items())  # nothing is linked that is not similar
    assert sum(got[d] == want[d] for d in want) >= 0.95 * len(want)


def test_no_table_goes_through_the_driver(spark, monkeypatch):
    """Whatever its size, no table of fingerprints, links or classes is broadcast."""
    from planlens.llm import components

    plans, put = [], simhash.materialise

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name)

    monkeypatch.setattr(simhash, "materialise", kept)
    monkeypatch.setattr(components, "materialise", kept)
    prints = spark.createDataFrame([(i, (1 << i % 15) - 1) for i in range(30)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: prints)
    found = simhash.near_duplicates(prints)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {r.component_id for r in found.collect()} == {0} and len(plans) > 5
    assert not [p for p in plans if "Broadcast" in p]
