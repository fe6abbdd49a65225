"""Approximate nearest neighbours by collision counting.

Largest inner product becomes smallest distance by one more coordinate
(sqrt(M^2 - |x|^2), 0 for queries).  A shard keeps, for each of many random
projections, its vectors sorted by that single projection.  A query opens a
window around its own projection in each array; windows widen together from
radius to radius (virtual rehashing: the arrays stay, only positions move).
A vector that has been in enough windows is verified exactly.  A query ends
once its k-th best distance is within the radius, since vectors within the
radius have passed the threshold with high probability by then.

Shards are bounded.  A shard's task gets its vectors first and sorts them
once; then the queries stream through it in batches, so that every vector is
shuffled once, every query once for each shard, and memory holds a shard and a
batch.  Only k rows a query leave a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ceil_div, stage

PROJECTIONS, HALF_WIDTH, SLACK, STEP = 128, 0.85, 1.6, 1.06
SHARD_ROWS = 16_384


def directions(dim: int, m: int = PROJECTIONS, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


class Shard:
    """Sorted projections of one shard's vectors."""

    def __init__(self, vectors: np.ndarray, norm: float, m: int = PROJECTIONS):
        self.x = vectors.astype(np.float64)
        extra = np.sqrt(np.maximum(0.0, norm**2 - (self.x**2).sum(axis=1)))
        self.a = directions(self.x.shape[1] + 1, m)
        p = np.column_stack([self.x, extra]) @ self.a
        order = np.argsort(p, axis=0, kind="stable")
        # the arrays stand one after another, each moved beyond the one before, so that one look-up serves all
        self.bound = float(np.abs(p).max(initial=0.0)) + 1.0
        self.moved = np.arange(m) * (4 * self.bound)
        self.sorted = (np.take_along_axis(p, order, axis=0) + self.moved).T.ravel()
        self.order = order.T.ravel()
        self.norm2, self.m = norm**2, m
        share = _inside(HALF_WIDTH)
        self.enough = max(1, int(np.floor(m * share - SLACK * np.sqrt(m * share * (1 - share)))))

    def first_radius(self, queries: np.ndarray, k: int) -> float:
        """Where windows begin: somewhat below the k-th distance of the luckiest of a few queries."""
        some = queries[np.linspace(0, len(queries) - 1, min(len(queries), 16)).astype(int)]
        d2 = self.norm2 + (some**2).sum(axis=1)[:, None] - 2 * some @ self.x.T
        kth = np.partition(d2, min(k, len(self.x)) - 1, axis=1)[:, min(k, len(self.x)) - 1]
        return float(max(np.sqrt(max(kth.min(), 0.0)), 1e-3 * np.sqrt(self.norm2) + 1e-12))

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, the k nearest found, as (row, inner product), best first, ties in row order."""
        n = len(self.x)
        q = queries.astype(np.float64)
        at = np.column_stack([q, np.zeros(len(q))]) @ self.a
        radius0 = self.first_radius(q, k)
        everyone = np.arange(n)
        for i in range(len(q)):
            if n <= k:
                yield self._best(everyone, self.x @ q[i], k)
                continue
            counts, score, lo, hi = np.zeros(n, dtype=np.int64), np.full(n, -np.inf), None, None
            radius, verified = radius0, 0
            while True:
                edge = lambda side: np.clip(at[i] + side * HALF_WIDTH * radius, -self.bound, self.bound) + self.moved  # noqa: B023, E731
                left, right = self.sorted.searchsorted(edge(-1)), self.sorted.searchsorted(edge(1), side="right")
                a, z = (left, right) if lo is None else (np.r_[left, hi], np.r_[lo, right])
                lo, hi = left, right
                counts += np.bincount(np.concatenate([self.order[b:e] for b, e in zip(a.tolist(), z.tolist(), strict=True)]), minlength=n)
                new = np.flatnonzero((counts >= self.enough) & np.isneginf(score))
                score[new] = self.x[new] @ q[i]
                verified += len(new)
                if verified >= k:
                    kth = np.sqrt(max(self.norm2 + q[i] @ q[i] - 2 * np.partition(score, n - k)[n - k], 0.0))
                    if kth <= radius or verified == n:
                        yield self._best(everyone, score, k)
                        break
                    radius = max(radius * STEP, min(kth, radius * STEP**3))
                else:
                    radius *= STEP**3

    @staticmethod
    def _best(rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > k:
            near = score >= np.partition(score, len(rows) - k)[len(rows) - k]
            rows, score = rows[near], score[near]
        best = np.lexsort((rows, -score))[:k]
        return rows[best], score[best]


def _inside(half: float) -> float:
    from math import erf, sqrt

    return erf(half / sqrt(2))


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row, itself excluded.

    Vectors that are null, zero or hold null or non-finite components, and
    rows with a null key, take no part; nor do vectors of another length than
    the query's.  Rows that share a key are one row, with the smallest of
    their vectors.  Equal vectors are one class: only its k + 1 smallest keys
    can be in an answer, so that many are kept, and all queries of a class
    share one search.  Ties go to the smaller key.  ``is_query`` may use key only.
    """
    x = F.col("vec")
    usable = F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"), is_query.alias("asks")).where(usable)
    one = rows.groupBy("id").agg(F.min(F.struct("vec", "asks")).alias("r")).select("id", F.col("r.vec").alias("vec"), F.col("r.asks").alias("asks"))
    base = stage(one, "ann-rows")
    ranked = base.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = stage(ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-classes")
    asked = base.where("asks").groupBy("vec").agg(F.min("id").alias("q"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    size = classes.agg(F.count(F.lit(1)), F.max(norm)).first()
    shards = max(1, ceil_div(size[0], shard_rows))
    longest = float(size[1] or 0.0)
    index = classes.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.size("vec").alias("dim"), F.lit(0).alias("asks"), F.col("ids")[0].alias("first"), "ids", "vec")
    wanted = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("vec").alias("dim"), F.lit(1).alias("asks"), F.col("q").alias("first"), F.array("q").alias("ids"), "vec")
    kind = vectors.schema[key].dataType.simpleString()
    # a shard's vectors in the order of their smallest key, then its queries
    dealt = index.unionByName(wanted).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "asks", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard, ids = None, [], None, []
        array = lambda col, dim: col.flatten().to_numpy().reshape(-1, dim)
        for whole in batches:
            codes = [whole.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1 if whole.num_rows else []
            for a, z in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                if a == z:
                    continue
                part, dim = whole.slice(a, z - a), int(codes[1][a])
                if at != (codes[0][a], dim):
                    at, held, shard, ids = (codes[0][a], dim), [], None, []
                if not codes[2][a]:
                    held.append(array(part.column(5), dim))
                    ids += part.column(4).to_pylist()
                    continue
                if not held:
                    continue  # no vector of that length here
                if shard is None:
                    shard = Shard(np.concatenate(held), longest)
                out_q, out_id, out_s = [], [], []
                for j, (found, score) in enumerate(shard.search(array(part.column(5), dim), k + 1)):
                    pairs = sorted(((-s, i) for r, s in zip(found.tolist(), score.tolist(), strict=True) for i in ids[r]))[: k + 1]
                    out_q += [j] * len(pairs)
                    out_s += [-s for s, _ in pairs]
                    out_id += [i for _, i in pairs]
                first = part.column(3)
                yield pa.RecordBatch.from_arrays([first.take(pa.array(out_q, pa.int64())), pa.array(out_id, first.type), pa.array(out_s, pa.float64())], names=["q", "id", "score"])

    found = dealt.mapInArrow(run, f"q {kind}, id {kind}, score double")
    order = [F.col("score").desc(), F.col("id")]
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    queries = base.where("asks").join(asked, "vec").select(F.col("id").alias("query_id"), "q")
    own = queries.join(best, "q").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
