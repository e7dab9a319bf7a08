"""Exact top-k inner-product search with KD-trees per shard.

A KD-tree over a sample of at most ``sample`` vectors cuts space into cells, and each vector goes to the shard of its cell; a cell with more than
``shard`` vectors is so many shards more, by a hash. Each shard builds one KD-tree, once: median splits on the widest dimension,
tight boxes. A query visits the boxes of a tree best first, by the largest inner product that any point of the box could
have, and stops when no box can beat its kth best score so far. Equal scores go to the smaller vec_id, so a box whose bound
equals the kth score is opened only if it holds a smaller id.

The kth score is propagated in two rounds: a query first searches the shard of its own cell, and then goes with the kth score
from there to those other shards only whose outer box can reach it. Queries meet a shard in groups of at most ``block``, in
tasks of their own; outer boxes are looked at ``boxes`` at a time. So no side is broadcast whole and neither is collected.

Defined cases: rows with a null vec_id, vector or component, or with a component that is not finite, take no part; every
other row is a candidate, rows equal in id and vector as often as they occur; equal rows ask once; rows of a query's own
vec_id are no candidates; shorter vectors count as padded with zeros; with fewer than k candidates all are returned; an empty
table gives an empty result; other columns are ignored. Components that ``scale`` takes beyond 2^28 raise an error, as their
products would overflow.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mapped, materialise, packed, unpacked

#: Products of larger components might not be exact in double arithmetic; they are computed in 64-bit integers.
EXACT = 1 << 20
#: With components up to here, sums of up to 128 products fit 64 bits.
LARGEST = 1 << 28
LOWEST = np.iinfo(np.int64).min


@dataclass
class Tree:
    """A leaf n holds points[a:b] with (a, b) = span[n]; other nodes have the children 2 * n + 1 and 2 * n + 2; index gives a node's row in the boxes."""

    ids: np.ndarray
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    span: dict[int, tuple[int, int]]
    index: dict[int, int]


def build(ids: np.ndarray, points: np.ndarray, leaf: int = 128) -> Tree:
    order = np.argsort(ids, kind="stable")
    boxes, span, todo = {}, {}, [(0, order)]
    placed, at = [], 0
    while todo:
        node, rows = todo.pop()
        part = points[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        boxes[node] = (lo, hi, ids[rows].min())
        width = hi - lo
        if len(rows) <= leaf or not width.any():
            span[node] = (at, at + len(rows))
            placed.append(np.sort(rows))
            at += len(rows)
            continue
        by = part[:, int(width.argmax())]
        cut = np.argsort(by, kind="stable")
        half = len(rows) // 2
        todo += [(2 * node + 1, rows[cut[:half]]), (2 * node + 2, rows[cut[half:]])]
    flat = np.concatenate(placed)
    nodes = sorted(boxes)
    index = {n: i for i, n in enumerate(nodes)}
    lo, hi, least = (np.array([boxes[n][j] for n in nodes]) for j in range(3))
    return Tree(ids[flat], points[flat], lo, hi, least, span, index)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a @ b


def bound(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any point of each box."""
    return dot(np.maximum(queries, 0), hi.T) + dot(np.minimum(queries, 0), lo.T)


def search(tree: Tree, qids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place of the query, id, score) of each query's best k points of this tree that reach its floor."""
    out = []
    bounds = bound(queries, tree.lo, tree.hi)
    index, least = tree.index, tree.least
    exact = max(np.abs(tree.points).max(initial=0), np.abs(queries).max(initial=0)) < EXACT
    points, asked = (tree.points.astype(float), queries.astype(float)) if exact else (tree.points, queries)
    for q, qid in enumerate(qids):
        best: list[tuple[int, int]] = []  # a heap of (score, -id); its root is the kth
        own, floor = bounds[q], floors[q]
        heap = [(-int(own[0]), 0)]
        while heap:
            top, node = heapq.heappop(heap)
            top, i = -top, index[node]
            if top < floor or len(best) == k and (top < best[0][0] or top == best[0][0] and least[i] > -best[0][1]):
                if top < floor or top < best[0][0]:
                    break
                continue
            if node not in tree.span:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(heap, (-int(own[index[child]]), child))
                continue
            a, b = tree.span[node]
            scores = points[a:b] @ asked[q]
            least_score = max(floor, best[0][0]) if len(best) == k else floor
            for j in np.flatnonzero(scores >= least_score):
                vid = int(tree.ids[a + j])
                if vid == qid:
                    continue
                item = (int(scores[j]), -vid)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        out += [(q, -n, s) for s, n in best]
    return out


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as long; rows that take no part are gone."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    beyond = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}: its products do not fit 64 bits")).cast("long")
    return rows.select("vec_id", F.transform("v", lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale).cast("long")).otherwise(beyond)).alias("v"))


def _matrix(vs: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim), np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


@dataclass
class Cells:
    """A complete KD-tree of ``depth`` levels: node i splits dimension dims[i] above cuts[i] and has the children 2 * i + 1 and 2 * i + 2."""

    depth: int
    dims: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, depth: int) -> Cells:
        dims, cuts, parts = [], [], [points]
        for _ in range(depth):
            halves = []
            for p in parts:
                d = int((p.max(axis=0) - p.min(axis=0)).argmax()) if len(p) else 0
                cut = int(np.median(p[:, d])) if len(p) else 0
                dims.append(d)
                cuts.append(cut)
                halves += [p[p[:, d] <= cut], p[p[:, d] > cut]]
            parts = halves
        return cls(depth, np.array(dims, np.int64), np.array(cuts, np.int64))

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dims[node]] > self.cuts[node])
        return node - ((1 << self.depth) - 1)


#: A shard is its cell's number times SPLIT and the number of the part of the cell.
SPLIT = 1 << 32


def dealt(rows: DataFrame, cells: Cells, dim: int, shard: int) -> DataFrame:
    """The rows with their shard."""

    def cell_of(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield b.assign(cell=cells.cell(_matrix(b["v"], dim)))

    placed = materialise(mapped(rows, cell_of, "vec_id long, v array<bigint>, cell long"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return placed.join(F.broadcast(sizes), "cell").select("vec_id", "v", (F.col("cell") * SPLIT + part).alias("shard"))


TREES = "shard long, ids binary, points binary, lo binary, hi binary, least binary, nodes array<bigint>, leaves array<bigint>, starts array<bigint>, ends array<bigint>, top_lo array<bigint>, top_hi array<bigint>"


def trees(placed: DataFrame, dim: int) -> DataFrame:
    """The tree of each shard, its outer box in top_lo and top_hi."""

    def grow(df: pd.DataFrame) -> pd.DataFrame:
        t = build(df["vec_id"].to_numpy(np.int64), _matrix(df["v"], dim))
        leaves = sorted(t.span)
        row = {x: packed(np.ascontiguousarray(getattr(t, x)).ravel()) for x in ("ids", "points", "lo", "hi", "least")}
        row |= {"nodes": sorted(t.index), "leaves": leaves, "starts": [t.span[n][0] for n in leaves], "ends": [t.span[n][1] for n in leaves], "top_lo": t.lo[0], "top_hi": t.hi[0]}
        return pd.DataFrame([{"shard": df["shard"].iloc[0], **row}])

    return placed.groupBy("shard").applyInPandas(grow, TREES)


def _tree(row: pd.Series, dim: int) -> Tree:
    flat = {x: unpacked(row[x], np.int64) for x in ("ids", "points", "lo", "hi", "least")}
    square = {x: flat[x].reshape(-1, dim) for x in ("points", "lo", "hi")}
    span = {int(n): (int(a), int(z)) for n, a, z in zip(row["leaves"], row["starts"], row["ends"], strict=True)}
    return Tree(flat["ids"], square["points"], square["lo"], square["hi"], flat["least"], span, {int(n): i for i, n in enumerate(row["nodes"])})


FOUND = "query_id long, ask long, vec_id long, score long"


def searched(asks: DataFrame, grown: DataFrame, by: list[str], dim: int, k: int) -> DataFrame:
    """query_id, ask, vec_id, score: what each query (query_id, ask, v, floor) finds in the trees with the same ``by``."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = search(_tree(right.iloc[0], dim), left["query_id"].to_numpy(np.int64), _matrix(left["v"], dim), left["floor"].to_numpy(np.int64), k)
        out = pd.DataFrame(found, columns=["q", "vec_id", "score"], dtype=np.int64)
        ids, ask = left["query_id"].to_numpy(np.int64), left["ask"].to_numpy(np.int64)
        return pd.DataFrame({"query_id": ids[out["q"]], "ask": ask[out["q"]], "vec_id": out["vec_id"], "score": out["score"]})

    return asks.groupBy(*by).cogroup(grown.groupBy(*by)).applyInPandas(meet, FOUND)


def reachable(asks: DataFrame, grown: DataFrame, dim: int, boxes: int) -> DataFrame:
    """The queries with each shard but their own whose outer box reaches their floor; boxes come to the queries ``boxes`` at a time."""
    outer, out, last = grown.select("shard", "top_lo", "top_hi"), None, -1
    while part := outer.where(F.col("shard") > last).orderBy("shard").limit(boxes).collect():
        shards, lo, hi = np.array([r.shard for r in part]), np.array([r.top_lo for r in part]), np.array([r.top_hi for r in part])
        last = int(shards[-1])

        def batches(it: Iterator[pd.DataFrame], shards: np.ndarray = shards, lo: np.ndarray = lo, hi: np.ndarray = hi) -> Iterator[pd.DataFrame]:
            for b in it:
                most = bound(_matrix(b["v"], dim), lo, hi)
                q, s = np.nonzero((most >= b["floor"].to_numpy(np.int64)[:, None]) & (shards[None, :] != b["shard"].to_numpy(np.int64)[:, None]))
                yield b.iloc[q].assign(shard=shards[s])

        found = mapped(asks, batches, "query_id long, ask long, v array<bigint>, floor long, shard long")
        out = found if out is None else out.union(found)
    return out if out is not None else asks


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard: int = 8192, block: int = 2048, sample: int = 16_384, boxes: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score for the queries: rows whose vec_id is divisible by ``every``."""
    rows = materialise(quantised(vectors), "vectors")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(1, dim)
    seeds = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(min(sample, 64 * math.ceil(n / shard))).select("v").toPandas()
    depth = max(0, min(math.ceil(math.log2(max(1, n / shard))), int(math.log2(max(1, len(seeds) / 32)))))
    placed = materialise(dealt(rows, Cells.of(_matrix(seeds["v"], dim), depth), dim, shard), "shards")
    grown = materialise(trees(placed, dim), "trees")
    queries = placed.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "v").alias("ask"), "v", "shard")

    near = materialise(searched(queries.withColumn("floor", F.lit(LOWEST)), grown, ["shard"], dim, k), "near")
    kth = near.groupBy("query_id", "ask").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = queries.join(kth, ["query_id", "ask"], "left").select("query_id", "ask", "v", F.when(F.col("n") >= k, F.col("least")).otherwise(LOWEST).alias("floor"), "shard")
    asks = materialise(reachable(materialise(floors, "floors"), grown, dim, boxes), "asks")
    groups = asks.groupBy("shard").agg(F.ceil(F.count("*") / block).alias("groups"))
    far = asks.join(groups, "shard").withColumn("group", F.pmod(F.xxhash64("ask"), F.col("groups"))).drop("groups")
    copies = grown.join(groups, "shard").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")

    found = near.union(searched(far, copies, ["shard", "group"], dim, k))
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.col("score").desc(), "vec_id"))
    discard(rows)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
