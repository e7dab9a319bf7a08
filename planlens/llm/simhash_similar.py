"""Near-dedup by SimHash, and an exact similarity join for what SimHash leaves.

Fingerprints that differ in at most two bits are linked by their deletion variants (``simhash.links``), and full sets of shingles
confirm the links: the first classes. Two bits mean a shingle similarity well over 0.8, so copies less near are found by the
exact join that follows, which starts from these classes.

Nodes are distinct sets of shingle hashes, so texts become one node only if their shingles are the same. All shingles are
put in one order, common ones last. Two sets of a Jaccard similarity of ``similarity`` or more share a shingle among the
first n - ceil(similarity * n) + 1 of each (prefix filtering: Chaudhuri et al., 2006), for texts of any length, so the
texts that share such a shingle, a *bucket*, hold every link. Which shingles count as common is read from a sample of the
documents; it decides how large buckets get and never what is found.

A bucket is compared in two rounds, after the classes of SimHash. First each of its nodes with one, that which is in the largest buckets: copies of one
text share its shingles, so that is the text itself. A bucket whose nodes are one class by then is done. In the others all
pairs of nodes of different classes are looked at, where they are: a bucket goes to its task in blocks of at most ``block``
nodes, a crowded one as so many pairs of blocks, and only pairs that pass two bounds leave it. So a bucket of copies of one
text costs one comparison a node, and no pair that could join two classes is left out.

The bounds hold for all similar pairs: one on the sizes, one on the differing bits of two parity maps, which are never more
than the shingles that only one of the sets holds. Buckets carry short maps; the pairs that leave them meet again on maps of
two bits or more a shingle, which hardly any unlike pair passes. What passes both is compared exactly, by whole sets.
Connected components give the classes.

Defined cases are those of ``simhash``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES_RE, discard, mapped, materialise
from .components import connected_components
from .simhash import SEED, fingerprint, links

MAP_WORDS = 8
#: Pairs that a task holds before it sends them on.
PAIRS = 1 << 20
#: Hashes of texts that are broadcast at most.
FEW = 1 << 20
#: Documents, at most about, from which common shingles are read, and in how many of them these are.
SAMPLE, COMMON = 20_000, 5


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = WORD_BYTES_RE.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle)).view(np.int64)


def parity_map(sh: np.ndarray, words: int) -> np.ndarray:
    """That many words; each shingle flips one bit. The halves of a map of a power of two, combined by exclusive or, are the map of half the size."""
    bit = np.bincount((sh.view(np.uint64) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def wide_words(n: int) -> int:
    """A power of two, with two bits or more a shingle."""
    return max(MAP_WORDS, 1 << max(0, (2 * n - 1).bit_length() - 6))


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """The differing bits of two maps of unsigned words, the longer one folded to the size of the other."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many documents of the sample, sorted."""
    n = docs.count()
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            sh, c = np.unique(np.concatenate([shingle_set(t, shingle) for t in b["text"]]), return_counts=True)
            yield pd.DataFrame({"sh": sh, "c": c.astype(np.int64)})

    found = mapped(some, batches, "sh long, c long").groupBy("sh").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON).select("sh").toArrow()
    return np.sort(found["sh"].to_numpy())


def row_key(docs: DataFrame):
    """Equal for rows equal in id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def sets_of(docs: DataFrame, shingle: int, similarity: float, common) -> DataFrame:
    """A row for each document: key (``row_key``), doc_id, txt (a hash of the text), node, fp (its SimHash), n, map, wide, prefix."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = np.append(common.value, np.iinfo(np.int64).max)
        for b in it:
            node, fp, n, maps, wide, prefix = [], [], [], [], [], []
            for t in b["text"]:
                sh = shingle_set(t, shingle)
                node.append(xxhash.xxh64_intdigest(sh.tobytes(), SEED))
                fp.append(fingerprint(t))
                n.append(len(sh))
                wide.append(parity_map(sh, wide_words(len(sh))).tobytes())
                maps.append(parity_map(sh, MAP_WORDS))
                is_late = late[np.searchsorted(late, sh)] == sh
                size = len(sh) - math.ceil(similarity * len(sh) - 1e-9) + 1 if len(sh) else 0
                prefix.append(np.concatenate([sh[~is_late], sh[is_late]])[:size])
            yield pd.DataFrame({"key": b["key"], "doc_id": b["doc_id"].astype("Int64"), "txt": b["txt"], "node": np.array(node, np.uint64).view(np.int64), "fp": np.array(fp, np.uint64).view(np.int64), "n": n, "map": maps, "wide": wide, "prefix": prefix})

    rows = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("txt"))
    return mapped(rows, batches, "key long, doc_id long, txt long, node long, fp long, n int, map array<bigint>, wide binary, prefix array<bigint>")


def shared_prefixes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node: the shingles in the prefixes of nodes, without those that only one holds."""
    listed = sets.join(nodes.select(F.col("row").alias("key"), "node"), ["key", "node"], "left_semi").select("node", F.explode("prefix").alias("key"))
    several = listed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    return listed.join(several, "key", "left_semi").distinct()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("txt").alias(f"t{s}"), F.col("n").alias(f"n{s}"), F.col("wide").alias(f"w{s}"))
    most = (1 - similarity) / (1 + similarity)

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            keep = [differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= (m + n) * most + 1e-6 for x, y, m, n in zip(b["wa"], b["wb"], b["na"], b["nb"], strict=True)]
            yield b.loc[keep, ["a", "b", "ta", "tb"]]

    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb", "na", "nb", "wa", "wb")
    pairs = materialise(mapped(pairs, near, "a long, b long, ta long, tb long"), "candidates")

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"txt": b["txt"], "sh": [shingle_set(t, shingle) for t in b["text"]]})

    numbers = asked = materialise(pairs.select(F.col("ta").alias("txt")).union(pairs.select(F.col("tb").alias("txt"))).distinct(), "asked")
    if asked.count() <= FEW:  # so many numbers of eight bytes go to every executor; else texts are dealt out to meet them
        asked = F.broadcast(asked)
    texts = docs.select(F.xxhash64("text").alias("txt"), "text").join(asked, "txt", "left_semi").dropDuplicates(["txt"])
    texts = materialise(mapped(texts, sets, "txt long, sh array<bigint>"), "shingle-sets")

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.loc[keep, ["a", "b"]]

    joined = pairs.join(texts.select(F.col("txt").alias("ta"), F.col("sh").alias("x")), "ta").join(texts.select(F.col("txt").alias("tb"), F.col("sh").alias("y")), "tb")
    confirmed = materialise(mapped(joined.select("a", "b", "x", "y"), verify, "a long, b long"), "links")
    discard(pairs, texts, numbers)
    return confirmed


def simhash_pairs(nodes: DataFrame, bucket: int = 64) -> DataFrame:
    """a, b: nodes whose fingerprints are linked by deletion variants, each node of one fingerprint with the least of them.

    Fingerprints are linked by any of their nodes; sets confirm the pairs, so what is lost here is found by the exact join.
    """
    least = nodes.groupBy("fp").agg(F.min("node").alias("c"))
    same = nodes.select("node", "fp").join(least.hint("merge"), "fp").where("node <> c").select("node", "c")
    side = lambda s: least.select(F.col("fp").alias(s), F.col("c").alias(f"c{s}")).hint("merge")
    near = links(least.select("fp"), bucket).join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("node"), F.col("cb").alias("c"))
    return same.union(near).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def central_pairs(listed: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b: each node of a bucket with its most central one, if the bounds allow it."""
    sizes = listed.groupBy("key").agg(F.count("*").alias("size"))
    weight = listed.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    centre = listed.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("m")).select("key", F.col("m.node").alias("c"))
    pairs = listed.join(centre, "key").where("node <> c").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("map").alias(f"m{s}"))
    may = F.expr(f"least(na, nb) >= {similarity} * greatest(na, nb) - 1e-6 and aggregate(zip_with(ma, mb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= (na + nb) * {(1 - similarity) / (1 + similarity)} + 1e-6")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b")


def apart_pairs(listed: DataFrame, nodes: DataFrame, found: DataFrame, similarity: float, block: int) -> DataFrame:
    """a, b: all pairs of a bucket whose nodes are in different classes of ``found``, if the bounds allow them."""
    roots = found.withColumn("root", F.coalesce("root", "node"))
    classed = listed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = classed.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("key", F.ceil(F.col("size") / block).alias("blocks"))
    rows = classed.join(open_, "key").join(nodes.select("node", "n", "map"), "node").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.select("key", "node", "root", "n", "map", "at", other.alias("with")).select("*", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))
    met = rows.groupBy("key", "i", "j").agg(F.collect_list(F.struct("node", "root", "n", "map", "at")).alias("g")).where(F.size("g") > 1)
    met = met.select((F.col("i") == F.col("j")).alias("same"), "g.node", "g.root", "g.n", F.flatten("g.map").alias("map"), "g.at")
    most = (1 - similarity) / (1 + similarity)

    def distinct(held: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *held]), axis=0)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in it:
            for r in b.itertuples():
                node, root, n, at = (np.asarray(x) for x in (r.node, r.root, r.n, r.at))
                maps = np.asarray(r.map).view(np.uint64).reshape(len(node), MAP_WORDS)
                for x in range(len(node) - 1):
                    y = slice(x + 1, None)
                    ok = (root[y] != root[x]) & (np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]) - 1e-6)
                    if not r.same:
                        ok &= at[y] != at[x]
                    ok[ok] = np.bitwise_count(maps[y][ok] ^ maps[x]).sum(axis=1) <= (n[y][ok] + n[x]) * most + 1e-6
                    if ok.any():
                        held.append(np.column_stack([np.minimum(node[y][ok], node[x]), np.maximum(node[y][ok], node[x])]))
                        size += len(held[-1])
                if size >= PAIRS:  # a pair is in many buckets of a task: it leaves once
                    held = [distinct(held)]
                    if len(held[0]) > PAIRS // 2:
                        yield pd.DataFrame(held.pop(), columns=["a", "b"])
                    size = sum(map(len, held))
        yield pd.DataFrame(distinct(held), columns=["a", "b"])

    return mapped(met, batches, "a long, b long").distinct()


def classes_of(docs: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """key, doc_id, root: a row for each document, the same root for those of one class."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    sets = materialise(sets_of(docs, shingle, similarity, common), "sets")
    nodes = materialise(sets.groupBy("node").agg(F.min(F.struct("key", "txt", "fp", "n", "map", "wide")).alias("s")).select("node", F.col("s.key").alias("row"), "s.txt", "s.fp", "s.n", "s.map", "s.wide"), "nodes")
    listed = materialise(shared_prefixes(sets, nodes), "buckets")
    rows = materialise(sets.select("key", "doc_id", "node"), "rows")
    discard(sets)
    first = simhash_pairs(nodes).union(central_pairs(listed, nodes, similarity)).distinct()
    near = verified(first, docs, nodes, shingle, similarity)
    found = connected_components(near)
    more = verified(apart_pairs(listed, nodes, found, similarity, block), docs, nodes, shingle, similarity)
    found = connected_components(near.union(more))
    out = materialise(rows.join(found, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root")), "classes")
    discard(nodes, listed, rows, near, more)
    return out


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """doc_id, component_id: the classes of documents linked by a similarity of ``similarity`` or more, named by their smallest doc_id."""
    rows = classes_of(docs, shingle, similarity, block)
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest doc_id stays, with all its columns.

    Rows without a doc_id come last in that order, rows of one doc_id go by a hash of the text; of rows repeated in id and
    text any one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"]
    kept = classes_of(docs, shingle, similarity, block).groupBy("root").agg(first.alias("__key")).select("__key").distinct()
    return docs.withColumn("__key", row_key(docs)).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
