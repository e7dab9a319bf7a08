"""MinHash near-duplicates by min-max hashing.

A permutation of the 64-bit shingle hashes gives a document two values, the least and the greatest hash. Two sets agree in
each with a probability of their Jaccard similarity, so half the permutations make a signature of the same length, and one
with a lower variance, as the two seldom err together (Ji et al., 2013). ``bands`` groups of ``rows`` values are hashed to
band keys, and documents that share one are compared on their full sets. At a similarity of exactly 0.8 a link is missed by all
of 50 bands of 5 values with a probability of (1 - 0.8^5)^50 = 2.4e-9; more similar ones hardly ever.

Nodes are distinct shingle sets, so copies are one from the start. A bucket is never expanded into pairs: its nodes meet one
of them first, and only where that leaves more than one class, others meet in blocks where they are, behind bounds that
hold for all similar pairs (``simhash_similar`` has these steps, which only need lists of nodes that share a key).
Connected components of the links that full sets confirm give the classes.

Defined cases: words are split and lower-cased as in ``simhash``; a null text counts as empty; a document without words has no
shingle and is a class of its own; fewer words than a shingle make one of all; repeated rows are in one class; a class
is named by its smallest doc_id, null only if all its rows have none, and a row is kept if its doc_id is that name, null
for null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, materialise, mix
from .components import connected_components
from .simhash import SEED
from .simhash_similar import MAP_WORDS, apart_pairs, central_pairs, parity_map, row_key, shingle_set, verified, wide_words

#: Shingles that are hashed at once.
STRETCH = 1 << 16


def permutations(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands: x -> a * x + b is a bijection of the 64-bit numbers."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row for each set, none empty: the least hashes under each permutation, then the greatest."""
    out = np.empty((len(sets), 2 * len(a)), np.uint64)
    starts = np.cumsum([len(s) for s in sets]) - [len(s) for s in sets]
    flat = np.concatenate(sets)
    with np.errstate(over="ignore"):
        for i, (factor, summand) in enumerate(zip(a, b, strict=True)):
            h = flat * factor
            h += summand
            out[:, i] = np.minimum.reduceat(h, starts)
            out[:, len(a) + i] = np.maximum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A row of ``bands`` keys for each signature; keys of different bands differ."""
    values = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(values.shape[2]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i])
    return h.view(np.int64)


def _groups(sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Indexes of the sets that are not empty, about STRETCH shingles at a time."""
    held, size = [], 0
    for i, s in enumerate(sets):
        if len(s):
            held.append(i)
            size += len(s)
        if size >= STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """A row for each document: key (``row_key``), doc_id, txt (a hash of the text), node (of the set), n, map, wide, and its band keys."""
    if bands * rows % 2:
        raise ValueError("each permutation gives two values of the signature: bands * rows must be even")
    a, b = permutations(bands * rows // 2)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            sets = [shingle_set(t, shingle).view(np.uint64) for t in df["text"]]
            keys: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
            for group in _groups(sets):
                for i, k in zip(group, band_keys(signatures([sets[i] for i in group], a, b), bands), strict=True):
                    keys[i] = k
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            maps = [parity_map(s, MAP_WORDS) for s in sets]
            wide = [parity_map(s, wide_words(len(s))).tobytes() for s in sets]
            yield pd.DataFrame({"key": df["key"], "doc_id": df["doc_id"], "txt": df["txt"], "node": node, "n": [len(s) for s in sets], "map": maps, "wide": wide, "bands": keys})

    found = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("txt"))
    return mapped(found, batches, "key long, doc_id long, txt long, node long, n int, map array<bigint>, wide binary, bands array<bigint>")


def near_duplicates(docs: DataFrame, shingle: int = 4, similarity: float = 0.8, bands: int = 50, rows: int = 5, block: int = 512) -> DataFrame:
    """doc_id, n_shingles (distinct ones), component_id and kept, a row for each document."""
    sets = materialise(signed(docs, shingle, bands, rows), "signatures")
    of = F.min(F.struct("key", "txt", "n", "map", "wide", "bands")).alias("s")
    nodes = materialise(sets.where("n > 0").groupBy("node").agg(of).select("node", "s.txt", "s.n", "s.map", "s.wide", "s.bands"), "nodes")
    documents = materialise(sets.select("doc_id", "node", "n"), "rows")
    discard(sets)
    banded = nodes.select("node", F.explode("bands").alias("key"))
    several = banded.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    listed = materialise(banded.join(several, "key", "left_semi"), "buckets")
    links = verified(central_pairs(listed, nodes, similarity), docs, nodes, shingle, similarity)
    first = connected_components(links)
    more = verified(apart_pairs(listed, nodes, first, similarity, block), docs, nodes, shingle, similarity)
    found = connected_components(links.union(more))
    full = documents.where("n > 0").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = materialise(full.select("doc_id", "n", "root"), "classes")
    discard(nodes, listed, links, more)
    names = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = full.join(names, "root").select("doc_id", "n", "component_id")
    alone = documents.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.union(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
