"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

Two fingerprints within `radius` bits agree in at least BLOCKS - radius of
their BLOCKS blocks, so each is sent to one shard per choice of that many
blocks, and links are looked for within shards only.  A shard's fingerprints
form a BK-tree: children keyed by their Hamming distance to the parent, and a
search follows only the edges within the radius.  Shard trees are built in the
task that holds the shard: nothing is broadcast, since all trees together grow
with the data.  A shard gives the edges of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stage

SEED, SHINGLE, BLOCKS, RADIUS = 42, 3, 4, 2


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is one if it is set in over half of the shingles' hashes; no words: zero."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxh64_intdigest(b" ".join(words), SEED)
    join = b" ".join
    h = np.fromiter((xxh64_intdigest(join(x), SEED) for x in zip(*(words[i:] for i in range(size)), strict=False)), dtype="<u8", count=len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (a long with the 64 bits) for every row; null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            step = max(1, (1 << 24) // max(1, texts.nbytes // max(1, batch.num_rows)))
            for a in range(0, batch.num_rows, step):
                raws = texts.slice(a, step).cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint(r or b"") for r in raws], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, step), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class BKTree:
    """A BK-tree over distinct 64-bit values, built and searched level by level for many values at once.

    node i holds values[i]; child[(i, distance)] is kept as a sorted array of
    i * 65 + distance with the child's number beside it.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        edges, ends = [], []
        # all values that still look for a place, and the node that they stand at
        waiting, at = np.arange(1, n), np.zeros(max(0, n - 1), dtype=np.int64)
        while len(waiting):
            code = at * 65 + _bits(values[waiting] ^ values[at])
            order = np.argsort(code, kind="stable")
            code, waiting = code[order], waiting[order]
            first = np.r_[True, code[1:] != code[:-1]]
            edges.append(code[first])  # the first of each goes there as a new child
            ends.append(waiting[first])
            at = np.repeat(waiting[first], np.diff(np.r_[np.flatnonzero(first), len(code)]))[~first]
            waiting = waiting[~first]
        code = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        child = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
        order = np.argsort(code)
        self.code, self.child = code[order], child[order]

    def search(self, wanted: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in wanted, node) of all values within the radius, in blocks."""
        for a in range(0, len(wanted), 512):
            who = np.arange(a, min(a + 512, len(wanted)))
            node = np.zeros(len(who), dtype=np.int64)
            while len(who):
                d = _bits(wanted[who] ^ self.values[node])
                near = d <= radius
                yield who[near], node[near]
                lo = np.searchsorted(self.code, node * 65 + np.maximum(0, d - radius), side="left")
                hi = np.searchsorted(self.code, node * 65 + np.minimum(64, d + radius), side="right")
                n = hi - lo
                edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                who, node = np.repeat(who, n), self.child[edge]


def shard_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, smallest value of its component) that connect all values of a shard within the radius."""
    if len(values) == 2:
        if _bits(values[:1] ^ values[1:])[0] <= radius:
            return values[1:], values[:1]
        return values[:0], values[:0]
    root = np.arange(len(values))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BKTree(values)
    for a, b in tree.search(values, radius):
        # most are in one component soon: only pairs that still differ are joined one by one
        while True:
            ra = root[a]
            while (root[ra] != ra).any():
                ra = root[ra]
            rb = root[b]
            while (root[rb] != rb).any():
                rb = root[rb]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            np.minimum.at(root, hi, lo)
    for i in range(len(root)):
        root[i] = find(i)
    other = root != np.arange(len(root))
    return values[other], values[root[other]]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    width = 64 // blocks
    kept = list(combinations(range(blocks), blocks - radius))
    block = lambda i: F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1)
    shards = []
    for c, own in enumerate(kept):
        name = F.lit(0).cast("long")
        for i in own:
            name = F.shiftleft(name, width).bitwiseOR(block(i))
        shards.append(F.struct(F.lit(c).alias("choice"), name.alias("shard")))
    sent = distinct.select("fp", F.explode(F.array(*shards)).alias("s")).select("s.choice", "s.shard", "fp")
    placed = sent.repartition("choice", "shard").sortWithinPartitions("choice", "shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(c: np.ndarray, s: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1])]) if len(c) else np.zeros(0, dtype=np.int64)
            ends = np.r_[first[1:], len(c)]
            found = [shard_links(f[a:b], radius) for a, b in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist(), strict=True)]
            x = np.concatenate([p for p, _ in found]) if found else f[:0]
            y = np.concatenate([q for _, q in found]) if found else f[:0]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            if not batch.num_rows:
                continue
            if held and (held[0][0][0], held[0][1][0]) == (new[0][-1], new[1][-1]):
                held.append(new)  # still the same shard
                continue
            c, s, f = (np.concatenate(x) for x in zip(*held, new, strict=True))
            tail = np.flatnonzero((c != c[-1]) | (s != s[-1]))
            cut_at = tail[-1] + 1 if len(tail) else 0
            if cut_at:
                yield emit(c[:cut_at], s[:cut_at], f[:cut_at])
            held = [(c[cut_at:], s[cut_at:], f[cut_at:])]
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return placed.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for each node of edges (a, b).

    Alternating stars: every node's larger neighbours are hung on its smallest
    one, then the smaller ones are; the number of rounds grows with the
    logarithm of a component's size.  Each round is checkpointed.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sums(now)
    while before[0]:
        pairs = both(now)
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = cut(small.where(F.col("a") != F.col("b")).distinct())
        after = sums(now)
        if after == before:
            break
        before = after
    roots = now.groupBy("a").agg(F.min("b").alias("b"))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id: one row per row of docs.

    component_id is the smallest key reachable over links of at most `radius`
    differing bits, the row's own included.  Equal fingerprints are one class,
    so copies are never paired.  Null text has no words (fingerprint zero, which links like
    any other); rows with a null key take part and get the smallest key of
    their component, null if it has none.  Other columns are not read.
    """
    fps = stage(fingerprints(docs, key, text), "simhash")
    classes = fps.groupBy("fp").agg(F.min("key").alias("rep"))
    distinct = stage(classes, "simhash-classes")
    found = links(distinct.select("fp"), radius)
    joined = components(found)
    # a component's smallest key, over the classes that have links
    linked = joined.join(distinct, joined["node"] == distinct["fp"]).select("node", "root", "rep")
    own = joined.select(F.col("root")).distinct()
    roots = own.join(distinct, own["root"] == distinct["fp"]).select(F.col("root").alias("node"), "root", "rep")
    members = linked.unionByName(roots)
    smallest = members.groupBy("root").agg(F.min("rep").alias("least"))
    moved = members.join(smallest, "root").select(F.col("node").alias("fp"), "least")
    # written, so that both sides of the last join are dealt anew and a hot fingerprint's part can be split
    where = stage(distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "simhash-components")
    return fps.join(where, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
