"""Language-model scoring with a log-frequency Bloom filter.

Training counts all words and all pairs of neighbours over all training documents. Words and pairs are known by 64-bit
hashes. Pair counts are quantised on a log scale, q = 1 + floor(log_BASE(count)), and the filter holds the keys (pair, 1) to
(pair, q): a reader probes 1, 2, ... until a key is missing and so recovers q (Talbot and Brants, 2008), up to the highest
level that the filter holds.

A filter of one piece would outgrow any broadcast, so it is cut into *parts* by the range of the hash, about one for each
``part_words`` words of training text, with ``BITS`` bits a key at every size: the error rate does not depend on the
input. The parts are a table in the shared folder. What is sent around is packed: documents are tokenised once into batches of
about ``batch_words`` words, a batch asks each part for its distinct hashes in that range (one row of bytes for each batch
and part), and the part answers with one byte of level for each pair and with the exact count for each word. So no part,
batch or vocabulary is ever in one place with all others, and a very frequent word is one hash in a batch.

A word w after u has p(w | u) = L(u) * f(u, w) / c(u) + (1 - L(u)) * p(w) with f the recovered count, p(w) the add-one
estimate of the base score, and L(u) = c(u) / (c(u) + TRUST), so that rare contexts trust the single words.

Defined cases: null texts are empty and consist of the end token; with no training documents V and N are 0 and all
probabilities are 1; repeated rows each get their row; a null doc_id is a training document; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES_RE, mapped, materialise, mix, packed, unpacked

#: No word holds a space.
END = b" "
BASE = 1.5
TRUST = 200.0
HASHES = 3
BITS = 10


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


# ---------------------------------------------------------------- the filter


def keys(pairs: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(level, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def places(key: np.ndarray, n_bits: int) -> list[np.ndarray]:
    """The HASHES bits of each key (double hashing)."""
    with np.errstate(over="ignore"):
        step = mix(key) | np.uint64(1)
        return [((key + step * np.uint64(j)) % np.uint64(n_bits)).astype(np.int64) for j in range(HASHES)]


@dataclass
class LogBloom:
    """n_bits bits, packed; no pair was put in above level ``top``."""

    bits: np.ndarray
    n_bits: int
    top: int

    @classmethod
    def of(cls, pairs: np.ndarray, c: np.ndarray, bits_per_key: int = BITS) -> LogBloom:
        """Holds (pair, 1..q) of each pair with its count c >= 1."""
        q = np.floor(np.log(c.astype(float)) / math.log(BASE)).astype(np.int64) + 1
        top, n_bits = int(q.max(initial=0)), max(64, -(-int(q.sum()) * bits_per_key // 8) * 8)
        marked = np.zeros(n_bits, bool)
        live = np.arange(len(pairs))
        for level in range(1, top + 1):
            live = live[q[live] >= level]
            for at in places(keys(pairs[live], level), n_bits):
                marked[at] = True
        return cls(np.packbits(marked), n_bits, top)

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """The recovered q of each pair, 0 if absent."""
        q, live, set_ = np.zeros(len(pairs), np.uint8), np.arange(len(pairs)), np.unpackbits(self.bits).view(bool)
        for level in range(1, self.top + 1):
            found = np.ones(len(live), bool)
            for at in places(keys(pairs[live], level), self.n_bits):
                found &= set_[at]
            live = live[found]
            if not len(live):
                break
            q[live] = level
        return q

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        return recovered(self.levels(pairs))


def recovered(q: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its step on the log scale; 0 for an absent pair."""
    return np.where(q > 1, BASE ** (q - 0.5), q.astype(float))


def build_filter(pairs: DataFrame) -> LogBloom:
    """One filter of (pair, c) rows in memory, for tables known to be small; ``train`` keeps its parts in a table."""
    rows = pairs.select("pair", "c").toArrow()
    return LogBloom.of(rows["pair"].to_numpy(), rows["c"].to_numpy())


# ---------------------------------------------------------------- batches of tokens


def packed_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as the gaps between them."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def hashed(text: str | None) -> np.ndarray:
    """The hashes of the words of a text, with A-Z lowered, and of the end token after them."""
    words = WORD_BYTES_RE.findall((text or "").encode("utf-8", "surrogatepass").lower())
    words.append(END)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


TOKENS = "batch long, n long, doc_id array<bigint>, named array<boolean>, held_out array<boolean>, sizes array<int>, words binary, tokens binary"


def tokenised(docs: DataFrame, batch_words: int) -> DataFrame:
    """The documents in batches: their distinct words in order of hash, and each document's tokens as places in that list. A null id is 0, not named."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))

    def row(batch: int, ids: list, named: list, held: list, found: list) -> pd.DataFrame:
        words, tokens = np.unique(np.concatenate(found), return_inverse=True)
        return pd.DataFrame({"batch": [batch], "n": [len(tokens)], "doc_id": [ids], "named": [named], "held_out": [held], "sizes": [list(map(len, found))], "words": [packed_sorted(words)], "tokens": [packed(tokens.astype(np.uint32))]})

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, ids, named, held, found, size = TaskContext.get().partitionId() << 36, [], [], [], [], 0
        for b in it:
            for doc_id, text, out in zip(b["doc_id"].astype("Int64"), b["text"], b["held_out"], strict=True):
                named.append(not pd.isna(doc_id))
                ids.append(int(doc_id) if named[-1] else 0)
                held.append(bool(out))
                found.append(hashed(text))
                size += len(found[-1])
                if size >= batch_words:
                    yield row(batch, ids, named, held, found)
                    batch, ids, named, held, found, size = batch + 1, [], [], [], [], 0
        if found:
            yield row(batch, ids, named, held, found)

    return materialise(mapped(rows, batches, TOKENS), "tokens")


@dataclass
class Batch:
    """A row of ``tokenised``: words (distinct hashes), tokens, sizes, and for all tokens but the last of a document where they are."""

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, sizes, words: bytes, tokens: bytes) -> Batch:
        sizes = np.asarray(sizes, np.int64)
        follows = np.ones(int(sizes.sum()), bool)
        follows[np.cumsum(sizes) - 1] = False
        return cls(unpacked_sorted(words), unpacked(tokens, np.uint32).astype(np.int64), sizes, np.flatnonzero(follows))

    def pairs(self) -> np.ndarray:
        """The hash of each pair of neighbours."""
        with np.errstate(over="ignore"):
            left = mix(self.words) * np.uint64(0x9E3779B97F4A7C15)
            return mix(left[self.tokens[self.at]] + self.words[self.tokens[self.at + 1]])


WORD_KEYS, PAIR_KEYS = 0, 1
ASKED = "part long, batch long, kind int, keys binary, c binary"


def asked(tokens: DataFrame, n_parts: int, training: bool) -> DataFrame:
    """What each batch has of each part: its distinct hashes, sorted, with their counts in training documents.

    ``training``: only the hashes that occur in those; else all of them, without counts.
    """

    def rows(batch: int, kind: int, key: np.ndarray, c: np.ndarray | None) -> Iterator[dict]:
        # only the parts that the batch has keys of are met, so the work of a batch does not grow with the number of parts
        part = ((key >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=False):
            yield {"part": int(part[a]), "batch": batch, "kind": kind, "keys": packed_sorted(key[a:z]), "c": packed(c[a:z]) if c is not None else b""}

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for r in b.itertuples():
                batch = Batch.of(r.sizes, r.words, r.tokens)
                words, pairs = batch.words, batch.pairs()
                if not training:
                    out = [*rows(r.batch, WORD_KEYS, words, None), *rows(r.batch, PAIR_KEYS, np.unique(pairs), None)]
                else:
                    learns = np.repeat(~np.asarray(r.held_out, bool), batch.sizes)
                    c = np.bincount(batch.tokens[learns], minlength=len(words)).astype(np.uint32)
                    key, n = np.unique(pairs[learns[batch.at]], return_counts=True)
                    out = [*rows(r.batch, WORD_KEYS, words[c > 0], c[c > 0]), *rows(r.batch, PAIR_KEYS, key, n.astype(np.uint32))]
                if out:
                    yield pd.DataFrame(out)

    return mapped(tokens.select("batch", "held_out", "sizes", "words", "tokens"), batches, ASKED)


def _summed(df: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of one kind with the sums of their counts."""
    df = df[df["kind"] == kind]
    key = np.concatenate([np.zeros(0, np.uint64), *map(unpacked_sorted, df["keys"])])
    c = np.concatenate([np.zeros(0, np.uint32), *(unpacked(x, np.uint32) for x in df["c"])])
    key, of = np.unique(key, return_inverse=True)
    return key, np.bincount(of, c, len(key)).astype(np.int64)


# ---------------------------------------------------------------- model and scores


@dataclass
class Model:
    """parts: part, n_words, words and c (the exact counts), bits, n_bits and top (of the filter); n tokens, v distinct ones."""

    parts: DataFrame
    n_parts: int
    n: int
    v: int


PARTS = "part long, n_words long, n long, words binary, c binary, bits binary, n_bits long, top int"


def train(tokens: DataFrame, part_words: int = 1_000_000, bits_per_key: int = BITS) -> Model:
    """The model of the training documents among ``tokens``."""

    def build(df: pd.DataFrame) -> pd.DataFrame:
        words, c = _summed(df, WORD_KEYS)
        bloom = LogBloom.of(*_summed(df, PAIR_KEYS), bits_per_key)
        return pd.DataFrame({"part": [df["part"].iloc[0]], "n_words": [len(words)], "n": [int(c.sum())], "words": [packed_sorted(words)], "c": [packed(c)], "bits": [bloom.bits.tobytes()], "n_bits": [bloom.n_bits], "top": [bloom.top]})

    n_parts = max(1, math.ceil((tokens.agg(F.sum("n")).first()[0] or 0) / part_words))
    parts = materialise(asked(tokens, n_parts, training=True).groupBy("part").applyInPandas(build, PARTS), "model")
    n, v = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    return Model(parts, n_parts, n, v)


def answers(tokens: DataFrame, model: Model) -> DataFrame:
    """batch, kind, part, got: for each row of ``asked`` the counts of its words or the levels of its pairs, in order."""

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(left):
            m = right.iloc[0] if len(right) else None
            words, c = (unpacked_sorted(m["words"]), unpacked(m["c"], np.int64)) if m is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            bloom = LogBloom(np.frombuffer(m["bits"], np.uint8), int(m["n_bits"]), int(m["top"])) if m is not None else LogBloom(np.zeros(8, np.uint8), 64, 0)
            asks = [unpacked_sorted(x) for x in left["keys"]]
            key, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, kind in zip(asks, left["kind"], strict=True) if kind == PAIR_KEYS)]), return_inverse=True)
            levels, done = bloom.levels(key)[of], 0
            for kind, h in zip(left["kind"], asks, strict=True):
                if kind == PAIR_KEYS:
                    got.append(levels[done : done + len(h)].tobytes())
                    done += len(h)
                else:
                    at = np.searchsorted(words, h)
                    known = np.append(words, np.uint64(0))[at] == h
                    got.append(packed(np.where(known & (at < len(words)), np.append(c, 0)[at], 0)))
        return left[["batch", "kind", "part"]].assign(got=pd.Series(got, index=left.index, dtype=object))

    asks = asked(tokens, model.n_parts, training=False).select("part", "batch", "kind", "keys")
    parts = model.parts.select("part", "words", "c", "bits", "n_bits", "top")
    return materialise(asks.groupBy("part").cogroup(parts.groupBy("part")).applyInPandas(answer, "batch long, kind int, part long, got binary"), "answers")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, batch_words: int = 1_000_000, part_words: int = 1_000_000, bits_per_key: int = BITS) -> DataFrame:
    """The columns of SCORES for every document, in log10."""
    tokens = tokenised(docs, batch_words)
    model = train(tokens, part_words, bits_per_key)
    found, n, d = answers(tokens, model), model.n, float(model.n + model.v + 1)

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["kind", "part"])
        got = lambda kind, t: np.concatenate([np.zeros(0, t), *(unpacked(x, t) for x in right["got"][right["kind"] == kind])])
        row = left.iloc[0]
        batch, c = Batch.of(row["sizes"], row["words"], row["tokens"]), got(WORD_KEYS, np.int64).astype(float)
        at, of, start = batch.at, np.unique(batch.pairs(), return_inverse=True)[1], np.cumsum(batch.sizes) - batch.sizes
        own = np.log10((c + 1) / d)
        base = own[batch.tokens]
        full, cu, f = base.copy(), c[batch.tokens[at]], recovered(got(PAIR_KEYS, np.uint8)[of])
        trust = cu / (cu + TRUST)
        seen = np.minimum(1.0, np.divide(f, cu, out=np.zeros(len(at)), where=cu > 0))
        full[at + 1] = np.log10(trust * seen + (1 - trust) * (c[batch.tokens[at + 1]] + 1) / d)
        each = lambda x: np.add.reduceat(x, start)
        return pd.DataFrame({"doc_id": pd.Series(row["doc_id"], dtype="Int64").where(np.asarray(row["named"], bool)), "held_out": row["held_out"], "n_tokens": batch.sizes, "n_known": each((c > 0).astype(np.int64)[batch.tokens]), "train_tokens": n, "base_score": each(base), "score": each(full)})

    rows = tokens.select("batch", "doc_id", "named", "held_out", "sizes", "words", "tokens")
    return rows.groupBy("batch").cogroup(found.groupBy("batch")).applyInPandas(scored, SCORES)
