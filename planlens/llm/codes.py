"""Vector codes by product quantisation, with segment-mean lower bounds in the search for the nearest entry.

Components become integers, floor(``scale`` * x), and vectors are cut into equal parts, each with a codebook of its own, fitted by
a fixed number of rounds: every part is assigned to its nearest entry, and entries become the floors of their parts' means.

The nearest entry is found coarse to fine. Cut x and an entry c into blocks of equal size; with the blocks' means and the norms
r of what is left over when these are taken off, |x - c|^2 is at least the sum of size * (mean_x - mean_c)^2 over the blocks plus
(r_x - r_c)^2. One block filters all entries, two and four filter those left, against the exact distance of the most
promising one; what survives gets its exact integer distance. Bounds are rounded down by more than any error of doubles,
so no entry that could be nearest is left out.

All rows are read where they lie: each task holds the codebooks (entries times dimensions, whatever the input) and sends one
row of sums for each part and entry, so that a round shuffles sums and no vectors.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; shorter vectors count as padded
with zeros, to a length that the parts divide; the codebooks start from the smallest vec_ids, rows of one id in the order
of their vectors, rows without an id last; with fewer rows than entries there are fewer entries; repeated rows each get
their row; null labels are kept; an empty table gives an empty result. Integers beyond 2^28 would overflow the distances and
raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 28
#: Blocks of the bounds, coarse to fine.
LEVELS = (1, 2, 4)
#: Rows that meet all entries at once.
ROWS = 1024


class Blocks:
    """Of rows of integers: for each level the blocks' sums over the root of their size, the norm of what is left, and how wrong that may be."""

    def __init__(self, x: np.ndarray) -> None:
        d = x.shape[1]
        square = (x * x).sum(axis=1).astype(float)
        self.sums, self.rest, slack = [], [], np.sqrt(square) * 2.0**-22
        for n in LEVELS:
            cuts = np.unique(np.arange(n) * d // n)
            sums = np.add.reduceat(x, cuts, axis=1) / np.sqrt(np.diff(np.append(cuts, d)))
            self.sums.append(sums)
            self.rest.append(np.sqrt(np.maximum(square - (sums * sums).sum(axis=1), 0.0)))
        self.slack = slack


def bound(x: Blocks, i: np.ndarray, c: Blocks, j: np.ndarray, level: int) -> np.ndarray:
    """At most the squared distance of the rows i of x and j of c."""
    gap = x.sums[level][i] - c.sums[level][j]
    left = np.maximum(np.abs(x.rest[level][i] - c.rest[level][j]) - x.slack[i] - c.slack[j], 0.0)
    return ((gap * gap).sum(axis=-1) + left * left) * (1 - 1e-9)


def nearest(x: np.ndarray, entries: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the index of the nearest entry, the lower of equal ones, and its squared distance. ``blocks`` are the entries'."""
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        rows = x[at : at + ROWS]
        own, every = Blocks(rows), np.arange(len(rows))
        low = bound(own, every[:, None], blocks, np.arange(len(entries))[None, :], 0)
        best = low.argmin(axis=1)
        most = ((rows - entries[best]) ** 2).sum(axis=1)
        i, j = np.nonzero(low <= most[:, None])
        for level in range(1, len(LEVELS)):
            low = bound(own, i, blocks, j, level)
            # the least bound is likely the nearest: its exact distance is what the others must beat
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            least = np.flatnonzero(low == np.minimum.reduceat(low, starts)[i])
            np.minimum.at(most, i[least], ((rows[i[least]] - entries[j[least]]) ** 2).sum(axis=1))
            keep = low <= most[i]
            i, j = i[keep], j[keep]
        exact = ((rows[i] - entries[j]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        least = np.minimum.reduceat(exact, starts)
        hit = np.flatnonzero(exact == least[i])
        first = hit[np.flatnonzero(np.diff(i[hit], prepend=-1))]
        index[at : at + ROWS], distance[at : at + ROWS] = j[first], least
    return index, distance


# ---------------------------------------------------------------- vectors


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.where(F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column hold a usable vector, and these as integers, padded with zeros."""
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    fine = (sizes >= 0) & (np.bincount(row[~np.isfinite(values)], minlength=len(sizes)) == 0)
    use = fine[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))
    scaled = np.floor(scale * values[use])
    if len(scaled) and np.abs(scaled).max() > LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}: its distances do not fit 64 bits")
    x = np.zeros((int(fine.sum()), dims), np.int64)
    x[(np.cumsum(fine) - 1)[row[use]], place[use]] = scaled.astype(np.int64)
    return fine, x


@dataclass
class Codebooks:
    """entries: part, entry, place within the part."""

    entries: np.ndarray
    scale: float

    @property
    def dims(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def assigned(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: the parts of all rows, their entries and distances."""
        n, _, d = self.entries.shape
        for p in range(n):
            part = np.ascontiguousarray(x[:, p * d : (p + 1) * d])
            yield part, *nearest(part, self.entries[p], Blocks(self.entries[p]))


SUMS = "part int, entry int, count long, sums array<long>"


def _summed(vectors: DataFrame, books) -> DataFrame:
    """A row of SUMS for each task, part and entry in use."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        parts, n, d = b.entries.shape
        count, sums = np.zeros((parts, n), np.int64), np.zeros((parts, n, d), np.int64)
        for batch in it:
            for p, (part, index, _) in enumerate(b.assigned(integers(batch.column(0), b.dims, b.scale)[1])):
                count[p] += np.bincount(index, minlength=n)
                for k in range(d):  # at most 10^4 rows of 2^28: exact in doubles
                    sums[p, :, k] += np.bincount(index, part[:, k], n).astype(np.int64)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "count", "sums"])

    return vectors.select("embedding").mapInArrow(batches, SUMS)


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> Codebooks | None:
    """The codebooks of all rows, or None if there are none. The driver sees entries only, never rows beyond the first ``entries``."""
    usable = kept(vectors)
    longest = usable.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    dims = -(-longest // parts) * parts
    first = usable.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()
    x = integers(first["embedding"].combine_chunks(), dims, scale)[1]
    now = np.ascontiguousarray(x.reshape(len(x), parts, dims // parts).transpose(1, 0, 2))
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        books = context.broadcast(Codebooks(now, scale))
        total = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(dims // parts)]
        means = _summed(vectors, books).groupBy("part", "entry").agg(F.sum("count").alias("count"), *total).collect()
        now = now.copy()
        for r in means:
            now[r["part"], r["entry"]] = [int(v) // r["count"] for v in r[3:]]
        books.unpersist()
    return Codebooks(now, scale)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (an entry for each part) and error, the squared distances of all parts together."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    label = vectors.schema["label"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in it:
            fine, x = integers(batch.column(2), b.dims, b.scale)
            found = [(index, distance) for _, index, distance in b.assigned(x)]
            rest = batch.select([0, 1]).filter(pa.array(fine))
            code = np.column_stack([i for i, _ in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(list(code), pa.list_(pa.int32())), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    return vectors.select(F.col("vec_id").cast("long"), "label", "embedding").mapInArrow(batches, f"vec_id long, label {label}, code array<int>, error long")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the errors of equal labels together. Sums are combined before the shuffle; a frequent label is split by the join."""
    total = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
