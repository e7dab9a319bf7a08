"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most two bits agree in one
segment but for one bit at most, so they share a *variant* of that segment: the segment with one bit position wiped
out. Each fingerprint is listed under its 64 variants, an equality join on the variant finds candidates, and the bit
distance verifies them. Connected components of the verified links give the duplicate classes.

Work is done on distinct fingerprints only: exact copies, and all texts with one fingerprint, are one row from the
start. A variant shared by many *distinct* fingerprints (over ``bucket`` of them) is not compared pair by pair: there each
fingerprint wipes out a second position of the 33 free bits, and all that then agree (four at most) are linked to the
least of them; two at distance two or less always meet that way.

All joins are by merge: fingerprints, links and classes grow with the corpus, and none of them goes through the driver, as a
broadcast would.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle of all words; repeated rows stay repeated and fall in one class; rows with a
null doc_id keep null and do not name a class unless all its rows have none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES_RE, mapped, materialise
from .components import connected_components

SEED = 42
SEGMENT = 32


def fingerprint(text: str | None, shingle: int = 3, chunk: int = 100_000) -> int:
    """The 64-bit SimHash of one text, unsigned. Bits are counted over chunks of shingles, so memory is bounded."""
    words = WORD_BYTES_RE.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(first[at : at + chunk], last[at : at + chunk], strict=True)], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            fp = np.fromiter((fingerprint(t, shingle) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), batches, "doc_id long, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(fp, key): the 64 one-wildcard segment variants of each fingerprint. A key is segment << 40 | position << 32 | what is left."""
    wiped = "transform(sequence(0, 31), i -> ({half} & ~shiftleft(1L, i)) | shiftleft(cast(i as bigint), 32) | {tag}L)"
    low, high = wiped.format(half="(fp & 4294967295L)", tag=0), wiped.format(half="shiftrightunsigned(fp, 32)", tag=1 << 40)
    return prints.select("fp", F.explode(F.expr(f"concat({low}, {high})")).alias("key"))


def links(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """(a, b), a < b: verified links that connect exactly what the links of two or fewer differing bits connect."""
    listed = variants(prints)
    counts = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(listed.join(counts.hint("merge"), "key"), "variants")
    segment, at = F.expr("cast(shiftright(key, 40) as int)"), F.expr("cast(shiftright(key, 32) & 255 as int)")
    # Small buckets: compare within the bucket; a pair counts only at its canonical position, the differing bit or else 0.
    small = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_set("fp").alias("fps"))
    half = F.expr("case when shiftright(key, 40) = 0 then (x ^ y) & 4294967295L else shiftrightunsigned(x ^ y, 32) end")
    pair = (
        small.select("key", "fps", F.posexplode("fps").alias("i", "x"))
        .select("key", "x", F.explode(F.expr("filter(slice(fps, i + 2, greatest(size(fps) - i - 1, 0)), y -> bit_count(x ^ y) <= 2)")).alias("y"))
        .where((half == 0) & (at == 0) | (half == F.expr("shiftleft(1L, cast(shiftright(key, 32) & 255 as int))")))
        .select(F.least(F.col("x"), F.col("y")).alias("a"), F.greatest(F.col("x"), F.col("y")).alias("b"))
    )
    # Large buckets: 33 bits are free (the other segment and the wiped one); wipe two of them and link equals to the least.
    free = F.when(segment == 0, F.expr("transform(sequence(32, 63), j -> j)")).otherwise(F.expr("transform(sequence(0, 31), j -> j)"))
    free = F.array_append(free, at + F.when(segment == 0, 0).otherwise(SEGMENT))
    large = shared.where(F.col("n") > bucket).select("fp", F.explode(free).alias("i"), free.alias("free"))
    large = large.select("fp", F.explode(F.expr("transform(filter(free, j -> j > i), j -> shiftleft(1L, i) | shiftleft(1L, j))")).alias("gone"))
    large = large.distinct().withColumn("kept", F.expr("fp & ~gone"))
    star = large.groupBy("kept", "gone").agg(F.min("fp").alias("a"), F.max("fp").alias("m"), F.collect_set("fp").alias("fps"))
    star = star.where("a <> m").select("a", F.explode("fps").alias("b")).where("a < b")
    return pair.union(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bucket: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id of its class)."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    found = connected_components(links(distinct.select("fp"), bucket))  # node, root
    classes = distinct.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids.hint("merge"), "root").select("fp", "component_id")
    return prints.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

