"""Shared helpers of the text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.group import GroupedData

from planlens.sources.staging import discard, materialise, shared_dir

__all__ = ["BASES", "WORD", "WORD_BYTES_RE", "WORD_RE", "discard", "filtered", "give_back", "given_back", "grouped", "mapped", "materialise", "mix", "packed", "read", "runs", "shared_dir", "slices", "sliding_argmin", "unpacked", "windows"]

#: A word: anything but a space or one of the ASCII control blanks U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
WORD_BYTES_RE = re.compile(WORD.encode())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(table: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    """As pandas would have it, but long columns with nulls stay whole numbers (as doubles they lose the digits of ids above 2^53), and strings are plain objects."""
    out = {}
    for i, name in enumerate(table.schema.names):
        column = table.column(i)
        whole = pa.types.is_integer(column.type) and column.null_count
        out[name] = column.to_pandas(types_mapper={column.type: NULLABLE[column.type]}.get) if whole else column.to_pandas()
        if isinstance(out[name].dtype, pd.StringDtype):
            out[name] = out[name].astype(object).where(out[name].notna(), None)
    return pd.DataFrame(out)


#: Rows of a batch that are Python objects at once.
SLICE = 2048


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def given_back(it: Iterator) -> Iterator:
    """``it``; when it ends, freed memory goes back to the system. Workers serve task after task, and would keep the most that any of them needed."""
    try:
        yield from it
    finally:
        give_back()


def slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


def mapped(rows: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``function`` over the rows in pandas frames, by way of Arrow, so that ids beside a null keep all digits."""
    kinds = arrow_schema(rows.sparkSession, schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in function(map(_frame, slices(it))):
            if len(b):
                yield pa.RecordBatch.from_pandas(b, kinds, preserve_index=False)

    return rows.mapInArrow(lambda it: given_back(batches(it)), schema)


def grouped(groups: GroupedData, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, spark: SparkSession) -> DataFrame:
    """``function`` over each group as a pandas frame, by way of Arrow like ``mapped``."""
    kinds = arrow_schema(spark, schema)
    return groups.applyInArrow(lambda table: pa.Table.from_pandas(function(_frame(table)), kinds, preserve_index=False), schema)


def filtered(rows: DataFrame, keep: Callable[[str | None], bool]) -> DataFrame:
    """The rows whose text ``keep`` is true of; no other column is touched."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            yield b.filter(pa.array([bool(keep(t)) for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return rows.mapInArrow(lambda it: given_back(batches(it)), rows.schema)


def packed(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: numbers that are mostly small are then long runs of zeros, which shuffle and files compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


# ---------------------------------------------------------------- hashing of word windows

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX2
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive values, built by doubling: the hash of a+b values joins those of a and b."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, block, size, power = None, 0, h, 1, base
    with np.errstate(over="ignore"):
        rest = k
        while rest:
            if rest & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += size
            rest >>= 1
            if rest:
                block = block[: len(block) - size] * power + block[size:]
                size, power = size * 2, power * power
        return mix(out)


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the index of its smallest, the rightmost of equal ones."""
    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(v)), 1
    while size * 2 <= w:
        a, b = best[: len(best) - size], best[size:]
        best, size = np.where(v[b] <= v[a], b, a), size * 2
    a, b = best[:n], best[w - size : w - size + n]
    return np.where(v[b] <= v[a], b, a)


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Half-open intervals that windows of ``length`` at these starts cover together."""
    if not len(starts):
        return []
    s = np.unique(starts)
    cut = np.flatnonzero(s[1:] > s[:-1] + length) + 1
    return [(int(g[0]), int(g[-1]) + length) for g in np.split(s, cut)]

