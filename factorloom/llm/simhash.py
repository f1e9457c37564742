"""SimHash near-duplicates, linked through BK-trees, with connected components.

A text's fingerprint comes from the XXH64 of its word shingles. Equal fingerprints fall together first; only distinct
ones are compared. Two 64-bit fingerprints that differ in at most RADIUS = 3 bits agree in at least one of four 16-bit
blocks, so each fingerprint enters four shards, one a block. A shard is one BK-tree (children keyed by their Hamming
distance to the parent); a search follows only the edges whose key is within the radius of the distance at hand. Trees of
all shards of a task are built and searched together, level by level, in numpy.

The members of a shard over TREE fingerprints are dealt anew by three of six blocks (20 keys of 32 bits), and if that isn't
enough by thirteen of sixteen (560 keys): any pair within the radius agrees in one of these keys too, and the last ones
leave 12 free bits, so no more than 4,096 fingerprints a tree. No shard tree
is broadcast: the set of distinct fingerprints grows with the input, so the trees are built where the shuffle puts the
shards.

A task returns, for each fingerprint, the smallest fingerprint that its shard's links reach (never the pairs
themselves); components over these stars are found by alternating large-star and small-star steps until nothing
changes, each step pinned in the shared folder.

Defined results: texts without words have fingerprint 0 and link like any other; null texts count as empty; repeated
rows appear as often as they come; rows with a null id have a fingerprint but never name a component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, only, pinned

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints in one tree, at most.
TREE = 4096
#: Numbers of bit blocks that fingerprints are dealt by, from few and coarse keys to many and fine ones.
LEVELS = (4, 6, 16)


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words joined by spaces, repeats included; of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    n = len(words)
    line = b" ".join(words)
    if n <= shingle:
        return np.array([h(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    return np.array([h(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return majority(shingle_hashes(words, shingle)) if words else 0


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; long texts are counted in blocks."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def batch(b):
            f = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            return {"doc_id": b["doc_id"], "fp": f.view(np.int64)}

        return batch

    return map_rows(only(docs, doc_id=id_col, text=text_col), f"doc_id {kind}, fp long", make)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of many shards, as arrays: node -> its children, sorted by (parent, distance to the parent)."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        """shard: number of each value's tree, sorted; value: uint64, distinct within a shard. Nodes are positions."""
        n = len(value)
        self.value, self.parent, self.key = value, np.full(n, -1), np.zeros(n, np.int64)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = first[np.cumsum(np.r_[True, shard[1:] != shard[:-1]]) - 1]
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[waiting]
        while len(waiting):
            d = _distance(value[waiting], value[at])
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            waiting, at, d, slot = waiting[order], at[order], d[order], slot[order]
            head = np.r_[True, slot[1:] != slot[:-1]]
            self.parent[waiting[head]], self.key[waiting[head]] = at[head], d[head]
            child = waiting[head][np.cumsum(head) - 1]  # the first to come to a free slot is the node there
            waiting, at = waiting[~head], child[~head]
        below = np.flatnonzero(self.parent >= 0)
        slots = self.parent[below] * 65 + self.key[below]
        order = np.argsort(slots)
        self.children, self.slots = below[order], slots[order]

    def links(self, radius: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes (i < j) of one tree within the radius, in blocks; each node searches its own tree."""
        n = len(self.value)
        step = 1 << 15
        for start in range(0, n, step):
            stack = [(q := np.arange(start, min(n, start + step)), self.root[q])]
            while stack:
                query, node = stack.pop()
                if len(query) > block:
                    half = len(query) // 2
                    stack += [(query[half:], node[half:]), (query[:half], node[:half])]
                    continue
                d = _distance(self.value[query], self.value[node])
                near = (d <= radius) & (query < node)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
                many = high - low
                some = many > 0
                if some.any():
                    q, lo, m = query[some], low[some], many[some]
                    offset = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    stack.append((np.repeat(q, m), self.children[np.repeat(lo, m) + offset]))


def smallest_reachable(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Union-find over nodes 0..n-1, a block of links at a time: each node's smallest reachable node."""
    low = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = low[a], low[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(low, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = low[low]
                if (up == low).all():
                    break
                low = up
    return low


def shard_stars(shard: np.ndarray, value: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint that it reaches in its shard), where they differ. Shards must be sorted."""
    order = np.lexsort((value, shard))
    shard, value = shard[order], value[order].view(np.uint64)
    if not len(value):
        return value.view(np.int64), value.view(np.int64)
    low = smallest_reachable(len(value), Forest(shard, value).links(radius))
    moved = np.flatnonzero(low != np.arange(len(value)))
    return value[moved].view(np.int64), value[low[moved]].view(np.int64)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, fp), sorted by shard, a shard never over TREE rows: a star row (fp, low) for each moved fingerprint."""
    schema = pa.schema([("fp", pa.int64()), ("low", pa.int64())])
    held_s, held_v = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(s, v):
        number = np.cumsum(np.r_[True, s[1:] != s[:-1]]) if len(s) else s
        a, b = shard_stars(number, v)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    for batch in batches:
        held_s = np.concatenate((held_s, batch.column(0).to_numpy(zero_copy_only=False)))
        held_v = np.concatenate((held_v, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(held_s) >= 1 << 16:
            cut = int(np.searchsorted(np.cumsum(held_s != held_s[-1]), (held_s != held_s[-1]).sum())) + 1 if held_s[0] != held_s[-1] else 0
            if cut:
                yield out(held_s[:cut], held_v[:cut])
                held_s, held_v = held_s[cut:], held_v[cut:]
    if len(held_s):
        yield out(held_s, held_v)


def _masks(blocks: int) -> list[int]:
    """All choices of ``blocks - RADIUS`` of so many bit blocks, as masks of 64 bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[k] for k in kept) for kept in itertools.combinations(range(blocks), blocks - RADIUS)]


def _shards(distinct: DataFrame, blocks: int) -> DataFrame:
    """(shard, fp): a row for each choice of blocks. Two fingerprints within the radius share a shard."""
    signed = [m - (1 << 64) * (m >> 63) for m in _masks(blocks)]
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for k, m in enumerate(signed)]
    return distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp")


def _linked(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard").select("shard", "fp").mapInArrow(_search, "fp long, low long")


def stars(distinct: DataFrame) -> DataFrame:
    """(fp, low) links that join every two distinct fingerprints within the radius, directly or through others.

    LEVELS: 4 keys of 16 bits, 20 of 32, 560 of 52. A set too large for 16 bits starts with 32; members of shards over
    TREE go to the next level, and the last one can't have more than TREE.
    """
    start = 1 if distinct.count() > TREE << 14 else 0
    found, left = [], distinct
    for blocks in LEVELS[start:]:
        rows = _shards(left, blocks)
        if blocks == LEVELS[-1]:
            found.append(_linked(rows))
            break
        large = pinned(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE).select("shard"))
        if not large.take(1):
            found.append(_linked(rows))
            break
        found.append(_linked(rows.join(large, "shard", "left_anti")))
        left = pinned(rows.join(large, "shard", "left_semi").select("fp").distinct())
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(fp, low): each linked node's smallest reachable node, by large-star and small-star steps until the links stand.

    The links shrink to one a node; every round is pinned in the shared folder, and only a count and a checksum of the
    links come to the driver.
    """
    edges = pinned(links.select(F.col("fp").alias("u"), F.col("low").alias("v")).where("u <> v"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    before = None
    while True:
        edges = pinned(star(star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("low"))


def link(marked: DataFrame) -> DataFrame:
    """doc_id, fp -> doc_id, fp, component_id. Only fingerprints shared or linked need a look-up: the rest name themselves."""
    groups = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = pinned(groups)
    roots = components(stars(groups.select("fp")))
    rooted = groups.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("low", "fp").alias("low"))
    # a table of its own, so that Spark can split the rows of a component that holds very many fingerprints
    of_root = pinned(rooted.groupBy("low").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1").select("low", "component_id"))
    wanted = rooted.join(of_root, "low").select("fp", "component_id")
    return marked.join(wanted, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    marked = pinned(fingerprints(docs, id_col, text_col, shingle))
    got = link(marked)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows that a near copy of smaller id stands for. Rows that share an id leave the first by text.

    Rows without an id can't be told apart and stay. Ids that come more than once are looked for among (id, fingerprint)
    rows; only if there are any do their texts move.
    """
    marked = pinned(fingerprints(docs, id_col, text_col, shingle))
    linked = link(marked)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    twice = pinned(marked.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(id_col)))
    if not twice.take(1):
        return kept
    order = Window.partitionBy(id_col).orderBy(text_col, F.xxhash64(*[F.col(c) for c in docs.columns]))
    first = kept.join(twice, id_col, "left_semi").withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*docs.columns)
    return kept.join(twice, id_col, "left_anti").select(*docs.columns).unionByName(first)
