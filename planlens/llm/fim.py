"""Fill-in-the-middle by a parallel automaton scan.

A text is cut at token bounds into prefix, middle and suffix, and these are written in another order between marks. Tokens are
runs of A-Z and a-z, and every other code point by itself. An automaton of four states reads the UTF-8 bytes: it tells
where tokens start and whether the text already holds a mark, which such a text must not be cut with.

A stretch of bytes acts on the automaton as a *function*: for each state it may be entered in, the state it is left in, and
how many tokens start and marks end on the way. Functions of neighbours compose, and composition is associative, so stretches
can be read in any order, anywhere. Texts are read in blocks of ``BLOCK`` bytes, all blocks of a batch in step. A document
of more than ``piece`` bytes is dealt out in pieces, equal pieces of copies once; each piece is one small row with its
function, composing them along the document gives the state and the number of tokens at the head of each, and so the piece
that holds each cut; only there is the cut looked for byte by byte.

Defined cases: a null text is empty; an empty text has no token and stays plain; a null doc_id draws its cuts as the empty
string in place of the number; rows repeated each get their row; other columns are ignored. Bytes that are no UTF-8 are
tokens each, or part of the one before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import grouped, materialise

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# ---------------------------------------------------------------- the automaton

LETTER, NAME, OPEN, CLOSE, OTHER, INNER, NOTHING = range(7)
#: Classes of bytes: letters, those that name a mark, its brackets, all else, bytes inside a code point. NOTHING fills blocks up.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INNER
for _c in range(26):
    CLASS[ord("A") + _c] = CLASS[ord("a") + _c] = LETTER
CLASS[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = NAME
CLASS[ord("<")], CLASS[ord(">")] = OPEN, CLOSE

#: States: outside a word, in a word, after an opening bracket, after that and the name of a mark (which is in a word, too).
STATES = OUTSIDE, WORD, OPENED, NAMED = range(4)


def _step(kind: int, state: int) -> tuple[int, bool, bool]:
    """The next state, whether a token starts here, and whether a mark ends here."""
    if kind in (INNER, NOTHING):
        return state, False, False
    if kind in (LETTER, NAME):
        return NAMED if kind == NAME and state == OPENED else WORD, state in (OUTSIDE, OPENED), False
    return OPENED if kind == OPEN else OUTSIDE, True, kind == CLOSE and state == NAMED


#: By 4 * class + state: the next state in the lower two bits, then a bit each for a token's start and a mark's end.
TABLE = np.array([n | t << 2 | m << 3 for kind in range(7) for n, t, m in (_step(kind, s) for s in STATES)], np.uint8)

BLOCK = 256
#: Bytes that are read in step at once.
STRETCH = 1 << 22


class Scan:
    """Functions of texts: ``to``, ``starts`` and ``marks`` have a row for each text and a column for each state it may be entered in."""

    def __init__(self, texts: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.blocks = -(-self.sizes // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        n = int(self.blocks.sum())
        classes = np.full(n * BLOCK, NOTHING, np.uint8)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        classes[np.arange(len(flat)) + np.repeat(self.first * BLOCK - (np.cumsum(self.sizes) - self.sizes), self.sizes)] = CLASS[flat]
        self.rows = np.ascontiguousarray(classes.reshape(n, BLOCK).T) * np.uint8(4)  # a row for each place in a block
        state = np.tile(np.arange(4, dtype=np.uint8), (n, 1))
        starts, marks = np.zeros((n, 4), np.uint16), np.zeros((n, 4), np.uint16)
        for row in self.rows:
            t = TABLE[row[:, None] + state]
            state = t & 3
            starts += t >> 2 & 1
            marks += t >> 3
        # along each text: all first blocks, then all second ones, and so on
        self.to = np.tile(np.arange(4, dtype=np.uint8), (len(texts), 1))
        self.starts, self.marks = np.zeros((len(texts), 4), np.int64), np.zeros((len(texts), 4), np.int64)
        self.entry, self.before = np.zeros((n, 4), np.uint8), np.zeros((n, 4), np.int64)
        order = np.argsort(-self.blocks, kind="stable")
        many = np.searchsorted(-self.blocks[order], -np.arange(int(self.blocks.max(initial=0))), side="left")
        for k, m in enumerate(many.tolist()):
            of = order[:m]
            b = self.first[of] + k
            held = self.to[of]
            self.entry[b], self.before[b] = held, self.starts[of]
            self.starts[of] += np.take_along_axis(starts[b], held, 1)
            self.marks[of] += np.take_along_axis(marks[b], held, 1)
            self.to[of] = np.take_along_axis(state[b], held, 1)

    def places(self, text: np.ndarray, entry: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The byte where the nth token (from 0) of each of these texts starts, if it is entered in that state; the size of the text if it has no more."""
        out = self.sizes[text].copy()
        inside = np.flatnonzero(nth < self.starts[text, entry])
        block = np.array([self.first[t] + np.searchsorted(self.before[self.first[t] : self.first[t] + self.blocks[t], e], r, side="right") - 1 for t, e, r in zip(text[inside], entry[inside], nth[inside], strict=True)], np.int64)
        state, left = self.entry[block, entry[inside]], nth[inside] - self.before[block, entry[inside]]
        for at, row in enumerate(self.rows if len(block) else ()):
            t = TABLE[row[block] + state]
            state, started = t & 3, (t >> 2 & 1).astype(bool)
            hit = started & (left == 0)
            out[inside[hit]] = (block[hit] - self.first[text[inside[hit]]]) * BLOCK + at
            left -= started
        return out


def _stretches(sizes: pd.Series) -> list[slice]:
    """Runs of texts of about STRETCH bytes together."""
    ends = np.flatnonzero(np.diff(np.cumsum(sizes.to_numpy(np.int64)) // STRETCH, prepend=0)).tolist()
    cuts = [0, *(e for e in ends if e), len(sizes)]
    return [slice(a, z) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def _scans(texts: pd.Series):
    for s in _stretches(texts.map(len)):
        yield s, Scan(texts.iloc[s].tolist())


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "marks", "a", "b")]))
def _cut(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Of texts in one piece: tokens, marks, and the bytes that prefix and middle end before."""
    out = np.zeros((len(text), 4), np.int64)
    for s, scan in _scans(text):
        n, each, entry = scan.starts[:, OUTSIDE], np.arange(len(scan.sizes)), np.full(len(scan.sizes), OUTSIDE)
        x, y = h1.to_numpy()[s] % (n + 1), h2.to_numpy()[s] % (n + 1)
        out[s] = np.column_stack([n, scan.marks[:, OUTSIDE], scan.places(each, entry, np.minimum(x, y)), scan.places(each, entry, np.maximum(x, y))])
    return pd.DataFrame(out, columns=["n", "marks", "a", "b"])


@F.pandas_udf(StructType([StructField(c, ArrayType(LongType())) for c in ("to", "starts", "marks")]))
def _function(part: pd.Series) -> pd.DataFrame:
    """The function of each piece."""
    found = [pd.DataFrame({"to": list(scan.to.astype(np.int64)), "starts": list(scan.starts), "marks": list(scan.marks)}) for _, scan in _scans(part)]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"to": [], "starts": [], "marks": []})


@F.pandas_udf(LongType())
def _place(part: pd.Series, entry: pd.Series, nth: pd.Series) -> pd.Series:
    """The byte of its piece that a cut comes before."""
    out = np.zeros(len(part), np.int64)
    for s, scan in _scans(part):
        out[s] = scan.places(np.arange(len(scan.sizes)), entry.to_numpy(np.int64)[s], nth.to_numpy(np.int64)[s])
    return pd.Series(out)


FOLDED = "key string, at int, entry int, before long, starts long, n long, marks long"


def _fold(df: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one document, composed from its start: how each is entered, how many tokens start before it and in it, and the totals. A document has at most 2 GB / ``piece`` of them."""
    df = df.sort_values("at", ignore_index=True)
    state, total, marks, rows = OUTSIDE, 0, 0, []
    for at, to, starts, ends in zip(df["at"], df["to"], df["starts"], df["marks"], strict=True):
        rows.append((at, state, total, int(starts[state])))
        state, total, marks = int(to[state]), total + int(starts[state]), marks + int(ends[state])
    return pd.DataFrame(rows, columns=["at", "entry", "before", "starts"]).assign(key=df["key"], n=total, marks=marks)


# ---------------------------------------------------------------- documents


def draws(doc_id: Column) -> list[Column]:
    """Four numbers for each document: the first groups of eight digits of the hex SHA-256 of 1: and its id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _cut_giants(big: DataFrame, piece: int) -> DataFrame:
    """``big`` with n, marks, a and b."""
    keyed = big.withColumn("key", F.sha2("bytes", 256))
    dealt = F.explode(F.expr(f"transform(sequence(0, (octet_length(bytes) - 1) div {piece}), i -> struct(cast(i as int) as at, substring(bytes, cast(i * {piece} + 1 as int), {piece}) as part))")).alias("x")
    pieces = keyed.select("key", dealt).select("key", "x.at", "x.part").groupBy("key", "at").agg(F.first("part").alias("part"))
    functions = pieces.select("key", "at", _function("part").alias("f")).select("key", "at", "f.*")
    folded = materialise(grouped(functions.groupBy("key"), _fold, FOLDED, big.sparkSession), "pieces")
    totals = folded.where("at = 0").select("key", "n", "marks")
    # where each cut is: the piece, how it is entered, and which of its tokens; the last piece if it is the text's end
    cut = F.array(F.least(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")), F.greatest(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")))
    asks = keyed.select("key", "h1", "h2").distinct().join(totals, "key").select("key", "h1", "h2", "n", "marks", F.posexplode(cut).alias("which", "k"))
    spot = folded.select("key", "at", "entry", "before", "starts")
    met = asks.join(spot, "key").where("k < n and k >= before and k < before + starts or k = n and at = 0")
    met = met.withColumn("spot", F.when(F.col("k") == F.col("n"), F.struct(F.lit(-1).alias("at"), F.lit(0).alias("entry"), F.lit(0).cast("long").alias("nth"))).otherwise(F.struct("at", "entry", (F.col("k") - F.col("before")).alias("nth"))))
    side = lambda i: F.max(F.when(F.col("which") == i, F.col("spot")))
    located = materialise(met.groupBy("key", "h1", "h2", "n", "marks").agg(side(0).alias("low"), side(1).alias("high")), "cuts")
    rows = keyed.join(located, ["key", "h1", "h2"])

    def byte(s: str) -> Column:
        part = F.when(F.col(f"{s}.at") >= 0, F.expr(f"substring(bytes, {s}.at * {piece} + 1, {piece})")).otherwise(F.lit(b""))
        return F.when(F.col(f"{s}.at") >= 0, F.col(f"{s}.at").cast("long") * piece + _place(part, f"{s}.entry", f"{s}.nth")).otherwise(F.octet_length("bytes").cast("long"))

    return rows.withColumn("a", byte("low")).withColumn("b", byte("high")).select(*big.columns, "n", "marks", "a", "b")


def transform(docs: DataFrame, plain: int = 10, spm: int = 20, piece: int = 1 << 16) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output, the new text.

    ``plain`` in a hundred documents stay as they are, as do texts that are empty or hold a mark; of the others ``spm`` in a hundred
    start with the suffix. Documents in one piece take one narrow pass; only those of more than ``piece`` bytes are dealt out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    rows = rows.select("doc_id", "bytes", *draws(F.col("doc_id")))
    size = F.octet_length("bytes")
    small = rows.where(size <= piece).withColumn("cut", _cut("bytes", "h1", "h2")).select(*rows.columns, "cut.*")
    both = small.unionByName(_cut_giants(rows.where(size > piece), piece))
    form = F.when((F.col("n") == 0) | (F.col("marks") > 0) | (F.expr("h3 % 100") >= 100 - plain), "plain").when(F.expr("h4 % 100") < spm, "spm").otherwise("psm")
    both = both.withColumn("form", form)
    text = lambda start, count: F.substring(F.col("bytes"), F.expr(f"cast({start} as int)"), F.expr(f"cast({count} as int)")).cast("string")
    parts = both.select("doc_id", "n", "form", F.col("bytes").cast("string").alias("text"), text("1", "a").alias("pre"), text("a + 1", "b - a").alias("mid"), text("b + 1", "octet_length(bytes) - b").alias("suf"))
    psm = F.concat(F.lit(PREFIX), "pre", F.lit(SUFFIX), "suf", F.lit(MIDDLE), "mid")
    whole = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), "suf", F.lit(PREFIX), "pre", F.lit(MIDDLE), "mid"))
    chars = lambda c: F.when(F.col("form") != "plain", F.char_length(c).cast("long"))
    return parts.select("doc_id", "n", "form", chars("pre").alias("prefix_chars"), chars("mid").alias("middle_chars"), whole.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made ``output`` of."""
    middle, rest = F.substring_index(output, MIDDLE, -1), F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substr(rest, F.lit(len(PREFIX) + 1)), SUFFIX, 1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(F.substr(rest, F.lit(len(SUFFIX) + 1)), PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
