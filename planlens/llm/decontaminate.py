"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(rate * m) edits. Cut into k + 1 pieces, at least one piece
must occur unchanged, so exact piece hits find every candidate place, and Myers' bit-parallel distance verifies the item
against the text around it. Pieces have few lengths. For each of them a rolling hash runs over the text, a bitmap passes the
places whose hash some piece may have, and those are compared with the piece itself.

The items are the stated query set: they go to the workers in blocks of at most ``block_chars`` characters, each block in
a pass of its own over all documents, so any number of items is handled and what is broadcast stays bounded, at about five
times that.

Texts and items are compared in lower case with white space turned into one space. Defined cases: null and empty texts
match nothing; items so short that they have no edit (under 1 / rate characters) must occur as whole words; null items, and items without any character left, match nothing; equal items are matched
once each; repeated documents each get their rows; null doc_ids are kept; other columns are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, mapped


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, limit: int) -> int:
    """The least edit distance of ``pattern`` to any substring of ``text``, or limit + 1 if it is above ``limit`` (Myers, 1999)."""
    m = len(pattern)
    if m == 0:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, get = full, 0, m, m, peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full  # the text may start anywhere, so nothing is carried in
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return min(best, limit + 1)


_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters of a text that are hashed at once.
STRETCH = 16_000


def _codes(text: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * _SPREAD


def _rolled(c: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the polynomial hash of all runs of that length, put together from runs of powers of two."""
    runs, size, power = {1: (c, _STEP)}, 1, _STEP
    with np.errstate(over="ignore"):
        while 2 * size <= max(lengths) and len(c) >= 2 * size:
            whole = runs[size][0]
            whole, power, size = whole[:-size] * power + whole[size:], power * power, 2 * size
            runs[size] = (whole, power)
        for length in lengths:
            n, done, h = len(c) - length + 1, 0, None
            if n <= 0:
                continue
            for size in sorted(runs, reverse=True):
                while length - done >= size:
                    part = runs[size][0][done : done + n]
                    h = part if h is None else h * runs[size][1] + part
                    done += size
            yield length, h


class Matcher:
    """Finds the items of one block in a text; those without an edit as whole words."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.ids, self.items, self.budget = [i for i, _ in items], [t for _, t in items], []
        pieces: dict[int, list[tuple[int, int]]] = {}  # by length: item, start
        for n, (_, text) in enumerate(items):
            k = math.floor(rate * len(text))
            self.budget.append(k)
            cuts = [j * len(text) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(b - a, []).append((n, a))
        self.lengths = sorted(pieces)
        total = sum(map(len, pieces.values()))
        self.shift = np.uint64(64 - min(26, max(10, (16 * total).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: hashes in order, their (item, start)
        for length, places in pieces.items():
            letters = _codes("".join(self.items[n][a : a + length] for n, a in places)).reshape(-1, length)
            h = letters[:, 0]
            with np.errstate(over="ignore"):
                for j in range(1, length):
                    h = h * _STEP + letters[:, j]
            order = np.argsort(h, kind="stable")
            self.tables[length] = (h[order], np.array(places, np.int64)[order])
            self.seen[(h >> self.shift).astype(np.int64)] = True

    def hits(self, t: str) -> list[tuple[int, int, int]]:
        """(end in the text, item, end in the item), ends exclusive, of each piece that occurs, in order."""
        out = []
        for base in range(0, len(t), STRETCH):
            part = t[base : base + STRETCH + self.lengths[-1] - 1]
            for length, h in _rolled(_codes(part), self.lengths):
                keys, places = self.tables[length]
                at = np.flatnonzero(self.seen[(h[:STRETCH] >> self.shift).astype(np.int64)])
                first = np.searchsorted(keys, h[at])
                at, first = at[first < len(keys)], first[first < len(keys)]
                for i, j in zip(at[keys[first] == h[at]].tolist(), first[keys[first] == h[at]].tolist(), strict=True):
                    found, key = part[i : i + length], keys[j]
                    while j < len(keys) and keys[j] == key:
                        n, a = places[j].tolist()
                        if self.items[n].startswith(found, a):
                            out.append((base + i + length, n, a + length))
                        j += 1
        return sorted(out)

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, distance) for every item within its budget somewhere in the text."""
        t = normalised(text)
        if not self.lengths or not t:
            return []
        regions: dict[int, list[list[int]]] = {}
        for end, n, b in self.hits(t):
            k, start = self.budget[n], end - b
            if not k:
                if not (t[start - 1 : start].isalnum() or t[end : end + 1].isalnum()):
                    regions[n] = []
                continue
            a, z = max(0, start - k), min(len(t), start + len(self.items[n]) + k)
            own = regions.setdefault(n, [])
            if own and a <= own[-1][1] and a >= own[-1][0]:
                own[-1][1] = max(own[-1][1], z)
            else:
                own.append([a, z])
        out = []
        for n, spans in sorted(regions.items()):
            k = self.budget[n]
            if self.items[n] in t:
                out.append((self.ids[n], 0))
                continue
            best = min(myers(self.items[n], t[a:z], k) for a, z in spans)
            if best <= k:
                out.append((self.ids[n], best))
        return out


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_chars`` characters; each is read by a query of its own."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield sorted(((r.item_id, t) for r in rows if (t := normalised(r.text))), key=str)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 32_000_000) -> DataFrame:
    """doc_id, item_id, distance: every document and item that it holds within the item's edit budget."""
    found = None
    for items in blocks(benchmark, block_chars):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(items, rate))

        def batches(it: Iterator[pd.DataFrame], matcher=matcher) -> Iterator[pd.DataFrame]:
            for b in it:
                found = [matcher.value.find(t) for t in b["text"]]
                doc_id = b["doc_id"].astype("Int64").repeat([len(f) for f in found]).reset_index(drop=True)
                yield pd.DataFrame({"doc_id": doc_id, "item_id": pd.array([i for f in found for i, _ in f], "Int64"), "distance": [e for f in found for _, e in f]})

        part = mapped(docs.select(F.col("doc_id").cast("long"), "text"), batches, "doc_id long, item_id long, distance int")
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_chars: int = 32_000_000) -> DataFrame:
    """The documents that hold no item, with all their columns; a narrow pass for each block of items."""
    for items in blocks(benchmark, block_chars):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(items, rate))
        docs = filtered(docs, lambda t, matcher=matcher: not matcher.value.find(t))
    return docs
