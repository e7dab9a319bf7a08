"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

The patterns give the base spans (``base_spans``). The field labels the words of a text as O, EMAIL, IP, CARD or PHONE from
features of each word's shape, its neighbours' classes and the transitions between labels. It is trained by gradient
ascent on the exact log-likelihood (forward-backward) over a small labelled table, and decoded by Viterbi in numpy over
padded batches of sequences. A sequence is a stretch of words in which a word with a digit or an at-sign is never more than
``REACH`` words away; all other words are O. The spans it adds are those that touch no base span.

Defined cases: a null text is empty and has no span; repeated rows each get their row; a null doc_id is kept; texts of any
length are read whole, the batches are bounded by words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD_RE, given_back, mapped, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
LOCAL = r"A-Za-z0-9._%+-"
LOCAL_END = re.compile(rf"[{LOCAL}]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits starts: all of these patterns take whole runs.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local@domain.domain, found from each at-sign, as a search from every letter could take quadratic time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind: leftmost non-overlapping matches; those that fail the check of their kind are dropped."""
    has_digit = any(d in text for d in "0123456789")
    out = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if has_digit:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ---------------------------------------------------------------- the field

REACH = 2
TRIM = ".,;:!?\"'<>[]{}"
CLASSES = ("edge", "word", "num1", "num3", "num4", "num", "dotted", "at", "plus", "paren", "dashed", "mixed")


@lru_cache(maxsize=200_000)
def word_class(word: str) -> str:
    """The coarse class of a word, which its neighbours see."""
    w = word.strip(TRIM)
    if "@" in w:
        return "at"
    if not any(c in "0123456789" for c in w):
        return "word"
    if w.startswith("+"):
        return "plus"
    if w.startswith("("):
        return "paren"
    if re.fullmatch(r"[0-9]+", w):
        return {1: "num1", 2: "num1", 3: "num3", 4: "num4"}.get(len(w), "num")
    if re.fullmatch(r"[0-9]+(\.[0-9]+)+", w):
        return "dotted"
    return "dashed" if re.fullmatch(r"[0-9]+(-[0-9]+)+", w) else "mixed"


def shape(word: str) -> str:
    """Letters become a, digits 9; runs are cut at 4; other marks stay."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word.strip(TRIM)))
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1", s)


@lru_cache(maxsize=200_000)
def own_features(word: str) -> tuple[str, ...]:
    w = word.strip(TRIM)
    digits = sum(c in "0123456789" for c in w)
    out = ["bias", "class=" + word_class(word)]
    if word_class(word) != "word":
        size = digits if digits < 6 else "6-12" if digits < 13 else "13-19" if digits < 20 else "20+"
        out += [f"shape={shape(word)}", f"digits={size}", f"dots={min(w.count('.'), 4)}", f"dashes={min(w.count('-'), 3)}", f"letters={any(c.isalpha() for c in w)}"]
        if word_class(word) == "dotted":
            out.append(f"octets={all(len(p) < 4 and int(p) < 256 for p in w.split('.'))}")
    return tuple(out)


@dataclass
class Field:
    own: dict[str, np.ndarray]
    before: np.ndarray
    after: np.ndarray
    trans: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        classes = np.array([CLASSES.index("edge"), *(CLASSES.index(word_class(w)) for w in words), CLASSES.index("edge")])
        zero = np.zeros(len(LABELS))
        own = np.array([sum((self.own.get(f, zero) for f in own_features(w)), zero) for w in words])
        return own + self.before[classes[:-2]] + self.after[classes[2:]]

    def decode(self, sequences: list[list[str]], batch_words: int = 100_000) -> list[np.ndarray]:
        """The best label sequence of each, by Viterbi over batches of sequences of similar length."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
        order, at = sorted(range(len(sequences)), key=lambda i: len(sequences[i])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(sequences[order[end]]) <= batch_words:
                end += 1
            picked = [i for i in order[at:end] if sequences[i]]
            at = end
            if not picked:
                continue
            lengths = np.array([len(sequences[i]) for i in picked])
            n, t = len(picked), int(lengths[-1])
            em = np.zeros((n, t, len(LABELS)))
            for row, i in enumerate(picked):
                em[row, : lengths[row]] = self.emissions(sequences[i])
            score, back = em[:, 0], np.zeros((n, t, len(LABELS)), np.int8)
            for s in range(1, t):
                step = score[:, :, None] + self.trans[None]
                best = step.argmax(axis=1)
                moved = np.take_along_axis(step, best[:, None, :], axis=1)[:, 0] + em[:, s]
                live = (s < lengths)[:, None]
                score = np.where(live, moved, score)
                back[:, s] = np.where(live, best, np.arange(len(LABELS))[None])
            labels = np.zeros((n, t), np.int8)
            labels[:, -1] = score.argmax(axis=1)
            for s in range(t - 1, 0, -1):
                labels[:, s - 1] = back[np.arange(n), s, labels[:, s]]
            for row, i in enumerate(picked):
                out[i] = labels[row, : lengths[row]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def fit(rows: list[tuple[list[str], list[str]]], rounds: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty by Adam; gradients from forward-backward over one padded batch."""
    rows = [r for r in rows if r[0]]
    n, t, k = len(rows), max((len(w) for w, _ in rows), default=1), len(LABELS)
    names = sorted({f for w, _ in rows for x in w for f in own_features(x)})
    index, c = {f: i for i, f in enumerate(names)}, len(CLASSES)
    lengths = np.array([len(w) for w, _ in rows])
    used, gold = np.zeros((n, t, len(names) + 2 * c)), np.zeros((n, t, k))
    for r, (words, labels) in enumerate(rows):
        cls = [0, *(CLASSES.index(word_class(x)) for x in words), 0]
        for s, x in enumerate(words):
            used[r, s, [index[f] for f in own_features(x)]] = 1
            used[r, s, [len(names) + cls[s], len(names) + c + cls[s + 2]]] = 1
            gold[r, s, LABELS.index(labels[s])] = 1
    live = np.arange(t)[None] < lengths[:, None]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    flat = used.reshape(n * t, -1)
    x, m, v = np.zeros((flat.shape[1] + k, k)), 0.0, 0.0
    for step in range(1, rounds + 1):
        w, trans = x[:-k], x[-k:]
        em = (flat @ w).reshape(n, t, k)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = em[:, 0]
        for s in range(1, t):
            a = _log_sum(alpha[:, s - 1][:, :, None] + trans[None], 1) + em[:, s]
            alpha[:, s] = np.where(live[:, s, None], a, alpha[:, s - 1])
        for s in range(t - 2, -1, -1):
            b = _log_sum(trans[None] + (em[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
            beta[:, s] = np.where(live[:, s + 1, None], b, 0.0)
        z = _log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + trans[None, None] + (em + beta)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        grad = np.concatenate([flat.T @ (gold - node).reshape(n * t, k), gold_pairs - pair.sum(axis=(0, 1))]) / n - l2 * x
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: x[i] for f, i in index.items()}, x[len(names) : len(names) + c], x[len(names) + c : -k], x[-k:])


# The words and the forms that the labelled table is made of.
CONTEXT = "the call mail of to at phone number is card from host server and see in page year total order item on for with write or fax ask token password version room".split()
FORMS = {
    "email": ["ab.12@mail3.example.com", "jane@example.org", "j.doe+x@host.example.net,", "opi.01@mail3.example.com"],
    "ip": ["17.252.227.210", "10.0.0.1", "192.168.12.7,", "8.8.4.4."],
    "card": ["4418452524842581", "4418 4525 2484 2581", "4418-4525-2484-2581", "371449635398431"],
    "phone": ["+1 (986) 555-4218", "(216) 555-1810", "+49 30 901820", "216-555-1810", "555-1810", "+33142685300"],
    "O": ["1998", "3.5", "12", "v2.10.3", "2024-05-17", "700", "12:30", "10.4.1999", "25a0bc4376e17c8019", "password=25a0bc4376e17c8019", '"4b579d3cee1dcaf48e80dfd04d785e"', "1,500", "300.400.500.600", "page7", "3-4", "99999", "@home", "1.2.3", "20000000", "(3)", "(1999)", "12345678901234567890123"],
}


def labelled_table(spark: SparkSession) -> DataFrame:
    """words, labels: the small labelled table, each form between context words in four places and some in pairs."""
    return spark.createDataFrame(labelled_rows(), "words array<string>, labels array<string>")


def labelled_rows() -> list[tuple[list[str], list[str]]]:
    rows, turn = [], 0

    def word() -> str:
        nonlocal turn
        turn += 7
        return CONTEXT[turn % len(CONTEXT)]

    for kind, forms in FORMS.items():
        for i, form in enumerate(forms):
            parts = form.split(" ")
            for left, right in ((2, 2), (1, 2), (2, 0), (0, 2)):
                words = [word() for _ in range(left)] + parts + [word() for _ in range(right)]
                rows.append((words, ["O"] * left + [kind] * len(parts) + ["O"] * right))
            other_kind = LABELS[(i + 1) % len(LABELS)]
            other = FORMS[other_kind][i % len(FORMS[other_kind])].split(" ")
            rows.append(([word(), *parts, word(), *other, word()], ["O", *[kind] * len(parts), "O", *[other_kind] * len(other), "O"]))
    return rows


def train(table: DataFrame, **options: float) -> Field:
    """Fit on the labelled table, which is small by definition: at most 10,000 of its rows, in sorted order, are read."""
    rows = table.where("words is not null and labels is not null and size(words) = size(labels)").orderBy("words", "labels").limit(10_000).collect()
    return fit([(list(r.words), list(r.labels)) for r in rows], **options)


MARKED = re.compile(r"[0-9@]")
MARKED_WORD = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """The spans of the words of each sequence: marked words and up to ``REACH`` words around them, merged where they meet."""
    out: list[list[tuple[int, int]]] = []
    at, near = 0, 0  # `near` words after the last marked one may still join its sequence
    first = MARKED.search(text)
    while first:
        # back up to the REACH words before this marked word, not before what is already placed
        start = first.start()
        while start > at and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        lead: list[tuple[int, int]] = []
        probe = start
        while len(lead) < REACH and probe > at:
            end = probe
            while end > at and text[end - 1] in " \t\n\x0b\x0c\r":
                end -= 1
            begin = end
            while begin > at and text[begin - 1] not in " \t\n\x0b\x0c\r":
                begin -= 1
            if begin == end:
                break
            lead.append((begin, end))
            probe = begin
        joined = bool(out) and not text[at : (lead[-1][0] if lead else start)].strip(" \t\n\x0b\x0c\r")
        if not joined:
            out.append([])
        out[-1] += lead[::-1]
        near, at = REACH, start
        while near >= 0 and (m := WORD_RE.search(text, at)):
            marked = MARKED.search(text, m.start(), m.end())
            if marked:
                near = REACH
            elif near == 0:
                break
            else:
                near -= 1
            out[-1].append(m.span())
            at = m.end()
        first = MARKED.search(text, at)
    return out


def field_spans(texts: list[str], model: Field) -> list[list[tuple[str, int, int]]]:
    """The spans of each text that the field labels. Words of an email or ip are spans of their own; cards and phones join."""
    where = [(i, seq) for i, t in enumerate(texts) for seq in sequences(t)]
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (i, seq), labels in zip(where, model.decode([[texts[i][a:b] for a, b in s] for i, s in where]), strict=True):
        last = 0
        for (a, b), label in zip(seq, labels.tolist(), strict=True):
            if label:
                if label == last and LABELS[label] in ("card", "phone"):
                    kind, start, _ = found[i].pop()
                    found[i].append((kind, start, b))
                else:
                    found[i].append((LABELS[label], a, b))
            last = label
    for i, spans in enumerate(found):
        t, out = texts[i], []
        for kind, a, b in spans:
            while a < b and t[a] in TRIM:
                a += 1
            while a < b and t[b - 1] in TRIM:
                b -= 1
            if a < b:
                out.append((kind, a, b))
        found[i] = out
    return found


def all_spans(texts: list[str], model: Field) -> list[tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]]:
    """For each text the base spans, and all spans: those and the field's that touch none of them."""
    out = []
    for text, extra in zip(texts, field_spans(texts, model), strict=True):
        base = base_spans(text)
        # of the base spans that start before a span ends, the one that reaches farthest tells whether any meets it
        taken = sorted(s for v in base.values() for s in v)
        starts, reach = [x for x, _ in taken], list(accumulate((y for _, y in taken), max))
        both = {k: list(v) for k, v in base.items()}
        for kind, a, b in extra:
            before = bisect_left(starts, b)
            if not before or reach[before - 1] <= a:
                both[kind].append((a, b))
        out.append((base, {k: sorted(v) for k, v in both.items()}))
    return out


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: Field) -> DataFrame:
    """One row per document: base counts and digest, and all spans as kind:start:end (code points, end exclusive)."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for base, both in all_spans([t or "" for t in b["text"]], model):
                counts = [len(base[k]) for k in KINDS]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), sum(map(len, both.values())) - sum(counts)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").values)
            yield out

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), batches, FOUND)


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """The documents with every span replaced by its kind in capitals and angle brackets, such as <EMAIL>; n_chars follows the text where there is such a column.

    Spans that overlap are replaced as one, named by the one that starts first.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            old = b.column("text").to_pylist()
            texts = [t or "" for t in old]
            new = []
            for text, given, (_, both) in zip(texts, old, all_spans(texts, model), strict=True):
                parts, at = [], 0
                for a, z, kind in sorted((a, z, k) for k, v in both.items() for a, z in v):
                    if a >= at:
                        parts += [text[at:a], f"<{kind.upper()}>"]
                    at = max(at, z)
                new.append("".join([*parts, text[at:]]) if parts else given)
            changed = {"text": new}
            if "n_chars" in b.schema.names:
                changed["n_chars"] = [len(t) if t is not None else n for t, n in zip(new, b.column("n_chars").to_pylist(), strict=True)]
            for name, values in changed.items():
                at = b.schema.get_field_index(name)
                b = b.set_column(at, b.schema.field(at), pa.array(values, b.schema.field(at).type))
            yield b

    return docs.mapInArrow(lambda it: given_back(batches(it)), docs.schema)
