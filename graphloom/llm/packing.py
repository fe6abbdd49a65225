"""Mixture-controlled packing: deficit round robin over source queues, in closed form.

Every source has a queue of tokens.  A window (sequence) takes from each queue
its share of the window plus the deficit that earlier windows left it, as a
whole number of tokens.  What a queue has been given before window k is a
function of k alone (served()), so that any partition computes its own windows,
and deficits carry over windows and partitions without any task seeing the
others' documents.  Documents are cut where a window's share ends, so all
windows but the last are full.

Every source has its own queue, at any number of sources: shares are looked up
in a tree over the queues' sums, in steps that grow with its depth only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage
from .token_count import _rows, counter

END_ID = 1
#: Windows or tokens looked up at a time.
LOOK_UPS = 1 << 18
PIECES = "doc_id {key}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def phases(totals: list[int], weights: list[float] | None = None) -> list[list[int]]:
    """Tokens that each queue gives in each phase.

    Without weights, one phase: shares follow the supply and all queues end
    together.  With weights, a phase ends when its first queue does, and the
    others go on in the proportions of their weights.
    """
    if weights is None:
        return [list(totals)]
    rest, out = list(totals), []
    while any(rest):
        live = [i for i, r in enumerate(rest) if r]
        if any(weights[i] > 0 for i in live):
            live = [i for i in live if weights[i] > 0]
        first = min(live, key=lambda i: (rest[i] / weights[i] if weights[i] > 0 else float(rest[i]), i))
        x = rest[first] / weights[first] if weights[first] > 0 else float(max(rest[i] for i in live))
        give = [0] * len(rest)
        for i in live:
            give[i] = rest[i] if i == first else min(rest[i], int(x * weights[i]) if weights[first] > 0 else rest[i])
        out.append(give)
        rest = [r - g for r, g in zip(rest, give, strict=True)]
    return out


def _share(x: np.ndarray, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """x * part // whole, exact for wholes below 2**61: an estimate, put right by the remainder, which is small again after wrapping."""
    whole = np.maximum(whole, 1)
    q = (x.astype(np.longdouble) * part / whole).astype(np.int64)
    return q + (x * part - q * whole) // whole


class Plan:
    """Phases in turn, each a pair of arrays: queues (rising) and the tokens they give."""

    def __init__(self, given: list[tuple[np.ndarray, np.ndarray]]):
        self.total, self.phases = 0, []
        for queues, tokens in given:
            some = np.asarray(tokens) > 0
            sums = np.r_[0, np.cumsum(np.asarray(tokens, dtype=np.int64)[some])]
            if some.any():
                self.phases.append((self.total, np.asarray(queues, dtype=np.int64)[some], sums))
                self.total += int(sums[-1])

    def at(self, queue: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that queue[j] has given when x[j] tokens are out, and those of all queues before it; whole, never falling.

        The queues of a phase are halved again and again; the first half gets the
        whole part of its share of what both get, the second the rest, its deficit carried on.
        """
        mine, ahead = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for began, queues, sums in self.phases:
            left = np.clip(x - began, 0, sums[-1])
            place = np.searchsorted(queues, queue)
            lo, hi = np.zeros(len(x), dtype=np.int64), np.full(len(x), len(queues))
            for _ in range((len(queues) - 1).bit_length()):
                mid = (lo + hi) // 2
                first = _share(left, sums[mid] - sums[lo], sums[hi] - sums[lo])
                later = place >= mid
                ahead += np.where(later, first, 0)
                left = np.where(later, left - first, first)
                lo, hi = np.where(later, mid, lo), np.where(later, hi, mid)
            ahead += np.where(place > lo, left, 0)
            mine += np.where(queues[lo] == queue, left, 0)
        return mine, ahead

    def windows(self, queue: np.ndarray, token: np.ndarray, size: int) -> np.ndarray:
        """The window that holds a token of a queue: the last one before which the queue has given no more than the tokens before it."""
        lo, hi = np.zeros(len(token), dtype=np.int64), np.full(len(token), max(0, -(-self.total // size) - 1))
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            fits = self.at(queue, np.minimum(mid * size, self.total))[0] <= token
            lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
        return lo


def served(x: np.ndarray, plan: list[list[int]]) -> np.ndarray:
    """served[s, j]: tokens queue s has given when x[j] tokens are out; they sum to x."""
    n = len(plan[0])
    whole = Plan([(np.arange(n), np.array(give, dtype=np.int64)) for give in plan])
    return np.stack([whole.at(np.full(len(x), s), np.asarray(x, dtype=np.int64))[0] for s in range(n)])


def pieces_of(queue: np.ndarray, begin: np.ndarray, n: np.ndarray, plan: Plan, size: int) -> tuple[np.ndarray, ...]:
    """Document, start, length, window and offset of the pieces of documents: n tokens from begin on in their queue."""

    def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = np.repeat(np.arange(len(count)), count)
        return doc, np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)

    k0, k1 = plan.windows(queue, begin, size), plan.windows(queue, begin + n - 1, size)
    dense = k1 - k0 < n
    doc, step = spread(np.where(dense, k1 - k0 + 1, 0))
    k = k0[doc] + step
    if not dense.all():  # a small queue gives nothing to most windows: only those of its tokens
        thin, step = spread(np.where(dense, 0, n))
        found = plan.windows(queue[thin], begin[thin] + step, size)
        new = np.r_[True, (thin[1:] != thin[:-1]) | (found[1:] != found[:-1])]
        doc, k = np.r_[doc, thin[new]], np.r_[k, found[new]]
        order = np.argsort(doc, kind="stable")
        doc, k = doc[order], k[order]
    lo, before = plan.at(queue[doc], np.minimum(k * size, plan.total))
    hi, after = plan.at(queue[doc], np.minimum((k + 1) * size, plan.total))
    start, end = np.maximum(lo, begin[doc]), np.minimum(hi, (begin + n)[doc])
    keep = end > start
    return tuple(c[keep] for c in (doc, start - begin[doc], end - start, k, after - before + start - lo))


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    weights: dict[str, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece: doc, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are the library's ids and END_ID.  Null text counts as
    empty (END_ID alone), null source as the queue ''.  Repeated rows are
    packed each; null keys stay null.  Order within a queue is that of the
    input's partitions.  Pass 1 writes the ids once, with each document's
    place in its partition's queues; sums per partition and queue give the
    places in the whole queues; pass 2 cuts.
    """
    kind = docs.schema[key].dataType.simpleString()
    queue = F.coalesce(F.col(source).cast("string"), F.lit(""))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = counter(path), TaskContext.get().partitionId()
        end, seen = np.uint32(END_ID).tobytes(), {}
        for batch in batches:
            for a, b in _rows(batch):
                ids = [x + end for x in tool.ids(batch.column(2).slice(a, b - a).cast(pa.binary()).to_pylist())]
                names = batch.column(1).slice(a, b - a).to_pylist()
                starts = []
                for name, x in zip(names, ids, strict=True):
                    starts.append(at := seen.get(name, 0))
                    seen[name] = at + (len(x) >> 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([part] * (b - a), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) >> 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["key", "queue", "part", "at", "n", "ids"],
                )

    cut = docs.select(F.col(key).alias("key"), queue.alias("queue"), F.col(text).cast("string").alias("text"))
    ids = stage(cut.mapInArrow(tokens, f"key {kind}, queue string, part int, at long, n long, ids binary"), "pack-ids")
    sums = ids.groupBy("part", "queue").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(sums.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "pack-bases")
    # written with its ids, which rise with the queues' names
    totals = stage(bases.groupBy("queue").agg(F.sum("tokens").alias("tokens")).sort("queue").withColumn("id", F.monotonically_increasing_id()), "pack-queues")
    table = totals.select("id", "tokens").toArrow()  # two numbers a source
    order = np.argsort(table.column(0).to_numpy())
    numbers, tokens_of = table.column(0).to_numpy()[order], table.column(1).to_numpy()[order]
    rest, given = np.ones(len(numbers), dtype=bool), []
    wanted = {s: float(w) for s, w in (weights or {}).items() if w > 0}
    if wanted:
        found = totals.where(F.col("queue").isin(list(wanted))).select("id", "queue").orderBy("id").collect()
        own = np.searchsorted(numbers, np.array([r["id"] for r in found], dtype=np.int64))
        rest[own] = False
        given = [(own, np.array(g, dtype=np.int64)) for g in phases([int(t) for t in tokens_of[own]], [wanted[r["queue"]] for r in found])]
    # those without a weight go on after the others, as the supply has it
    plan = Plan([*given, (np.flatnonzero(rest), tokens_of[rest])])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queues = np.searchsorted(numbers, batch.column(2).to_numpy())
            begin, n = batch.column(3).to_numpy() + batch.column(4).to_numpy(), batch.column(5).to_numpy()
            upto, a = np.cumsum(n), 0
            while a < len(n):
                z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LOOK_UPS, side="right")))
                doc, start, length, seq, off = pieces_of(queues[a:z], begin[a:z], n[a:z], plan, size)
                doc = doc + a
                at, crcs = -1, []
                for d, s, t in zip(doc.tolist(), start.tolist(), (start + length).tolist(), strict=True):
                    if d != at:
                        at, whole = d, memoryview(batch.column(6)[d].as_py())
                    crcs.append(zlib.crc32(whole[4 * s : 4 * t]))
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(off)],
                    names=["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                a = z

    numbered = bases.join(totals.select("queue", "id"), "queue").select("part", "queue", "base", "id")
    placed = ids.join(numbered, ["part", "queue"]).select("key", "queue", "id", "base", "at", "n", "ids")
    return placed.mapInArrow(pieces, PIECES.format(key=kind)).withColumnRenamed("doc_id", key)
