"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Sentence i has the toxic probability p_i = sigmoid(b + sum of the weights of its
distinct words and of their first ``PREFIX`` letters), and the document is toxic unless every sentence is clean: P = 1 - prod(1 - p_i) (noisy-or). Only
document labels are needed; the gradient of the document likelihood finds which sentences and words carry them, and the
trained model then names the offending sentences.

The classifier is fitted on at most ``max_docs`` labelled documents with at most ``max_words`` words together, chosen by
a hash of the text among those of at most ``max_chars`` characters, so that the sample fits the driver; scoring covers
every document and its whole text.

Defined cases: null and empty texts, and texts without words, have no sentence and score 0; label rows with a null id or
label are ignored, of several labels for one id the highest counts; without any usable label everything scores 0;
repeated rows each get their row; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, give_back, mapped

SENTENCE_RE = re.compile(r"[^.!?\n]+")
TOKEN_RE = re.compile(r"[^\W_]+")


#: Letters of a word's beginning that count as a feature of their own: inflected forms share it.
PREFIX = 4


def features(sentence: str) -> set[str]:
    """The distinct lower-cased words and the distinct beginnings of longer ones."""
    words = set(TOKEN_RE.findall(sentence.lower()))
    return words | {"^" + w[:PREFIX] for w in words if len(w) > PREFIX}


@dataclass
class NoisyOrModel:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    beginnings: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.beginnings = frozenset(f[1:] for f in self.weights if f[0] == "^")

    def sentence_logits(self, text: str | None) -> tuple[list[float], list[tuple[int, int]]]:
        """The logit and the span of every sentence that has a word."""
        logits, spans, weights, bias = [], [], self.weights, self.bias
        marked = self.beginnings
        for m in SENTENCE_RE.finditer(text or ""):
            words = set(TOKEN_RE.findall(m[0].lower()))
            if words:
                hits = {w for w in words if w in weights or w[:PREFIX] in marked}
                logits.append(bias + (sum(weights.get(f, 0.0) for f in hits | {"^" + w[:PREFIX] for w in hits if len(w) > PREFIX}) if hits else 0.0))
                spans.append(m.span())
        return logits, spans

    def score(self, logits: list[float]) -> float:
        """1 - prod(1 - sigmoid(z)), in logarithms."""
        if not logits:
            return 0.0
        return float(-np.expm1(-np.logaddexp(0.0, np.array(logits)).sum()))


#: Features that the fit has as doubles at once.
BLOCK = 1 << 18


def fit(texts: list[str], labels: list[int], min_docs: int = 3, rounds: int = 300, l1: float = 2e-4, rate: float = 0.1) -> NoisyOrModel:
    """Proximal Adam on the mean document log-likelihood with an L1 penalty on the word weights.

    Features are numbers of four bytes in flat arrays as they are met, and doubles a block at a time: objects for each sentence would fill the driver.
    """
    names: dict[str, int] = {}
    flat, sizes, counts, seen = array("i"), array("i"), [], array("i")  # features; features of a sentence; sentences of a text; texts of a feature
    for t in texts:
        start, before = len(flat), len(sizes)
        for s in SENTENCE_RE.findall(t or ""):
            if f := features(s):
                flat.extend([names.setdefault(w, len(names)) for w in f])
                sizes.append(len(f))
        counts.append(len(sizes) - before)
        seen.frombytes(bytes(4 * (len(names) - len(seen))))
        np.asarray(seen)[np.unique(np.asarray(flat[start:]))] += 1
    vocab = {w: i for i, w in enumerate(sorted(w for w, i in names.items() if seen[i] >= min_docs))}
    y = np.array([v for v, n in zip(labels, counts, strict=True) if n], float)
    if not vocab or not len(y) or y.min() == y.max():
        return NoisyOrModel()
    column = np.full(len(names), -1, np.int32)
    column[[names[w] for w in vocab]] = np.arange(len(vocab))
    del names, seen
    doc = np.repeat(np.arange(len(y)), [n for n in counts if n])
    sent = np.repeat(np.arange(len(sizes), dtype=np.int32), np.asarray(sizes))
    flat = column[np.asarray(flat)]
    kept = flat >= 0
    flat, sent = flat[kept], sent[kept]
    n_sent, n_docs = len(sizes), len(y)
    cuts = np.searchsorted(sent, np.arange(n_sent + 1))
    blocks, at = [], 0  # whole sentences each: (first and last sentence, first and last feature)
    while at < n_sent:
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BLOCK, "right")) - 1)
        blocks.append((at, end, int(cuts[at]), int(cuts[end])))
        at = end
    for _, _, i, j in blocks:
        flat[i:j] = flat[i:j][np.lexsort((flat[i:j], sent[i:j]))]
    x, m, v = np.zeros(len(vocab) + 1), 0.0, 0.0  # the last entry is the bias
    x[-1] = np.log(y.mean() * len(y) / n_sent)
    z, grad = np.zeros(n_sent), np.zeros(len(vocab) + 1)
    for step in range(1, rounds + 1):
        for a, b, i, j in blocks:
            z[a:b] = x[-1] + np.bincount(sent[i:j] - a, weights=x[flat[i:j]], minlength=b - a)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc, weights=np.logaddexp(0, z), minlength=n_docs)  # -log prod(1 - p)
        ratio = np.where(y > 0, -1 / np.expm1(np.maximum(clean, 1e-9)), 1.0)  # d loss / d clean
        g_sent = ratio[doc] * p / n_docs
        grad[:] = 0
        for _, _, i, j in blocks:
            np.add.at(grad, flat[i:j], g_sent[sent[i:j]])
        grad[-1] = g_sent.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x = x - scale * m / (1 - 0.9**step)
        x[:-1] = np.sign(x[:-1]) * np.maximum(0, np.abs(x[:-1]) - np.minimum(scale[:-1] * l1, 0.2))
    return NoisyOrModel(float(x[-1]), {w: float(x[i]) for w, i in vocab.items() if abs(x[i]) > 1e-6})


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_words: int = 4_000_000, max_chars: int = 64_000, **options) -> NoisyOrModel:
    """Fit on labelled documents outside the held-out fold. The sample is bounded by ``max_docs`` documents, of ``max_chars`` characters each, and ``max_words`` words."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("__id"), "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").where("text is not null").where(F.length("text") <= max_chars)
    # only ids are shuffled: a hash picks a tenth more of them than needed, and their texts alone are read by a broadcast join
    usable = rows.select("__id").join(known, "__id")
    share = min(1.0, 1.1 * max_docs / max(1, usable.count()))
    picked = usable.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().limit(2 * max_docs).collect()
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked], "__id long, toxic int")
    sample = rows.join(F.broadcast(chosen), "__id").select("text", "toxic", F.xxhash64("text").alias("h"), "__id").orderBy("h", "__id", "toxic").limit(max_docs).collect()
    texts, ys, words = [], [], 0
    for r in sample:
        words += r.text.count(" ") + 1
        if words > max_words:
            break
        texts.append(r.text)
        ys.append(int(r.toxic > 0))
    del sample, picked
    model = fit(texts, ys, **options)
    del texts
    give_back()  # the driver serves stage after stage, and would keep what the fit needed
    return model


SCORED = "score double, predicted int, n_sentences long, toxic_sentences array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: NoisyOrModel, threshold: float = 0.3, sentence_threshold: float = 0.3) -> DataFrame:
    """doc_id, the document score and decision, and the spans (code points, end exclusive) of the offending sentences."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = np.log(sentence_threshold / (1 - sentence_threshold))
        for b in it:
            rows = []
            for t in b["text"]:
                logits, spans = model.sentence_logits(t)
                p = model.score(logits)
                bad = [{"start": s, "end": e, "score": float(1 / (1 + np.exp(-z)))} for z, (s, e) in zip(logits, spans, strict=True) if z >= cut]
                rows.append((p, int(p >= threshold), len(logits), bad))
            out = pd.DataFrame(rows, columns=["score", "predicted", "n_sentences", "toxic_sentences"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").values)
            yield out

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), batches, "doc_id long, " + SCORED)


def reject(docs: DataFrame, model: NoisyOrModel, threshold: float = 0.3) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns, one pass and no join."""
    return filtered(docs, lambda t: model.score(model.sentence_logits(t)[0]) < threshold)
