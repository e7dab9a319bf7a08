"""Removal of passages that repeat, by seed and extend.

Seeds: the words of a text are hashed, each run of ``SEED`` words is hashed, and winnowing picks the least such hash of
every window of ``length`` words. Equal windows pick equal seeds, so documents are joined on seeds and only windows around a
seed that occurs twice go on. Extension: around each shared seed, the text is extended both ways, to the windows of
``length`` words in all alignments that have it as their pick; each is identified by a 96-bit hash and is a repeat if it
occurs anywhere else. Overlapping repeats merge into the maximal ones, whose words are removed.

No pairs are made: a seed or window is one row for each place, hot ones are combined inside each task first (a window met
twice there is known to repeat and needs one row only), and shared seeds are found by a partial count and an equality join.

Defined cases: null texts count as empty; texts under ``length`` words lose nothing; a repeat inside one document counts;
rows equal in all columns are copies of each other; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASES, WORD_RE, discard, mapped, materialise, runs, sliding_argmin, windows

SEED = 8
#: Words held at once by a task while it combines what it finds.
BUFFER = 1_500_000


class Hasher:
    """64-bit word hashes with a bounded memory of frequent words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known.clear()
        known, digest, out = self.known, xxhash.xxh64_intdigest, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, np.uint64)


def picks(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The seed hashes at all positions, and for each window of ``length`` words the position of its pick."""
    seeds = windows(h, SEED, BASES[0])
    return seeds, sliding_argmin(seeds, length - SEED + 1)


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 and text: rows equal in id and text share a key, which is never null."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _buffered(it: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """Batches joined up to about BUFFER words."""
    held, size = [], 0
    for b in it:
        held.append(b)
        size += int(b[column].str.len().sum()) // 6
        if size >= BUFFER:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def seeds(rows: DataFrame, length: int) -> DataFrame:
    """seed, k1, k2, n: the picked seeds of each document; n is how often the seed was picked in what its task held."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in _buffered(it):
            found, sizes = [], []
            for t in b["text"]:
                s, p = picks(hasher(WORD_RE.findall(t)), length)
                found.append(s[np.unique(p)])
                sizes.append(len(found[-1]))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
            out = pd.DataFrame({"seed": flat.view(np.int64), "k1": np.repeat(b["k1"].to_numpy(), sizes), "k2": np.repeat(b["k2"].to_numpy(), sizes), "n": np.minimum(counts[where], 2).astype(np.int32)})
            yield out.drop_duplicates()

    return mapped(rows.select("k1", "k2", "text"), batches, "seed long, k1 long, k2 long, n int")


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """k1, k2, spans: for each document that has any, the repeated windows as (start, end) words, end exclusive."""
    picked = materialise(seeds(rows, length), "seeds")
    shared = picked.groupBy("seed").agg(F.sum("n").alias("total")).where("total > 1").select("seed")
    around = picked.join(shared, "seed").groupBy("k1", "k2").agg(F.collect_set("seed").alias("seeds"))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in _buffered(it):
            h1s, h2s, doc, at = [], [], [], []
            for i, (t, known) in enumerate(zip(b["text"], b["seeds"], strict=True)):
                h = hasher(WORD_RE.findall(t))
                s, p = picks(h, length)
                start = np.flatnonzero(np.isin(s[p], np.asarray(known, np.int64).view(np.uint64)))
                h1s.append(windows(h, length, BASES[0])[start])
                h2s.append((windows(h, length, BASES[1])[start] >> np.uint64(32)).astype(np.int64))
                doc.append(np.full(len(start), i))
                at.append(start)
            h1, h2, doc, at = map(np.concatenate, (h1s, h2s, doc, at))
            if not len(h1):
                continue
            order = np.lexsort((h2, h1))
            h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
            first = np.ones(len(h1), bool)
            first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            group = np.cumsum(first) - 1
            again = np.bincount(group)[group] > 1
            k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
            # windows met twice here: one row without an address tells the others, the places are marked at once
            lone = ~again
            yield pd.DataFrame({"h1": h1[lone].view(np.int64), "h2": h2[lone], "k1": k1[doc[lone]], "k2": k2[doc[lone]], "a": at[lone].astype(np.int32), "b": np.zeros(lone.sum(), np.int32)})
            told = again & first
            yield pd.DataFrame({"h1": h1[told].view(np.int64), "h2": h2[told], "k1": np.zeros(told.sum(), np.int64), "k2": np.zeros(told.sum(), np.int64), "a": np.full(told.sum(), -1, np.int32), "b": np.zeros(told.sum(), np.int32)})
            doc, at = doc[again], at[again]
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            cut = np.flatnonzero(np.diff(doc)) + 1
            spans = [(k1[d[0]], k2[d[0]], a, z) for d, p in zip(np.split(doc, cut), np.split(at, cut), strict=True) if len(d) for a, z in runs(p, length)]
            if spans:
                m = pd.DataFrame(spans, columns=["k1", "k2", "a", "b"])
                yield m.assign(h1=0, h2=-1).astype({"a": "int32", "b": "int32"})[["h1", "h2", "k1", "k2", "a", "b"]]

    near = rows.join(around, ["k1", "k2"]).select("k1", "k2", "text", "seeds")
    found = materialise(mapped(near, batches, "h1 long, h2 long, k1 long, k2 long, a int, b int"), "windows")
    discard(picked)
    # a window has at most one row for each task's buffer here, as those combined their own
    same = Window.partitionBy("h1", "h2")
    lone = found.where("h2 >= 0").withColumn("n", F.count("*").over(same)).withColumn("least", F.min("a").over(same))
    lone = lone.where("a >= 0 and (n > 1 or least < 0)").select("k1", "k2", "a", (F.col("a") + length).alias("b"))
    spans = lone.union(found.where("h2 < 0").select("k1", "k2", "a", "b"))
    out = materialise(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "repeats")
    discard(found)
    return out


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = 35, keep_text: bool = False) -> DataFrame:
    """One row per document: its number of words, how many of them repeats cover, and the digest of the rest; with ``keep_text`` also ``kept``, the rest joined by single spaces."""
    rows = keyed(docs)
    found = repeats(rows, length)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for t, spans in zip(b["text"], b["spans"], strict=True):
                words = WORD_RE.findall(t)
                gone = np.zeros(len(words) + 1, np.int32)
                for s in spans if spans is not None else ():
                    gone[s["a"]] += 1
                    gone[s["b"]] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                kept = " ".join(w for w, k in zip(words, keep, strict=True) if k)
                out.append((len(words), len(words) - int(keep.sum()), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept))
            got = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])
            got.insert(0, "doc_id", b["doc_id"].astype("Int64").values)
            yield got if keep_text else got.drop(columns="kept")

    return mapped(rows.join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans"), batches, REMOVED + (", kept string" if keep_text else ""))
