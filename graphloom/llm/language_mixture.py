"""Language identification by multilingual mixture inference.

A document is taken as a mixture of languages: each of its character trigrams
comes from one of them.  Expectation-maximisation finds the proportions; the
set of languages is chosen by penalised likelihood, so that a language must
earn its place; the prediction is the language with the largest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BUCKETS = 1 << 16
#: Each language is learnt from at most this many rows (SALTS strata of equal size, by hash of the id).
ROWS_PER_LANGUAGE, SALTS = 1024, 256
#: Of more label values than this, those with the most rows are learnt: the model is LANGUAGES x BUCKETS numbers at most.
LANGUAGES = 256
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower case (first character), or 0 if it isn't a letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every trigram with a letter in its middle, and whether each text has a letter."""
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = _letters()[points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    edge = np.zeros(len(x), dtype=bool)
    edge[np.cumsum(sizes) - sizes] = True
    keep = (x > 0) | edge
    keep[1:] |= x[:-1] > 0  # one gap after each word
    x, doc = x[keep].astype(np.uint64), doc[keep]
    middle = np.flatnonzero(x[1:-1] > 0) + 1
    h = (x[middle - 1] * np.uint64(0x9E3779B97F4A7C15) + x[middle] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[middle + 1] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    has = np.zeros(len(texts), dtype=bool)
    has[doc[middle]] = True
    return doc[middle], bucket, has


def labelled(docs: DataFrame, usable: Column, key: str, text: str, lang: str) -> DataFrame:
    """The rows to learn from, with their own label: usable ones with key, text and label, and the label one of the LANGUAGES most frequent."""
    cols = {"_gl_key": F.col(key), "_gl_lang": F.col(lang).cast("string"), "_gl_hash": F.xxhash64(F.col(text).cast("string")), "_gl_text": F.col(text).cast("string")}
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(*(c.alias(n) for n, c in cols.items()))
    often = rows.groupBy("_gl_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "_gl_lang").limit(LANGUAGES + 1).collect()
    return rows if len(often) <= LANGUAGES else rows.where(F.col("_gl_lang").isin([r[0] for r in often[:LANGUAGES]]))


def sample(rows: DataFrame) -> DataFrame:
    """_gl_lang and _gl_text of at most ROWS_PER_LANGUAGE different (key, label, text) of each language, the same ones on every run.

    Chosen by hash, from narrow rows; their texts are fetched by a join on all three, so that another
    row of the same key, with another label or none, is never learnt in its place.  Copies of a row count once.
    """
    on = ["_gl_key", "_gl_lang", "_gl_hash"]
    order = F.xxhash64("_gl_key", "_gl_hash")
    w = Window.partitionBy("_gl_lang", F.pmod(order, F.lit(SALTS))).orderBy(order, "_gl_key", "_gl_hash")
    chosen = rows.select(*on).distinct().withColumn("_gl_n", F.row_number().over(w)).where(F.col("_gl_n") <= ROWS_PER_LANGUAGE // SALTS).drop("_gl_n")
    # at most LANGUAGES x ROWS_PER_LANGUAGE rows; copies of one meet before the shuffle
    return rows.join(F.broadcast(chosen), on).groupBy(*on).agg(F.max("_gl_text").alias("_gl_text")).select("_gl_lang", "_gl_text")


def train(docs: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities (BUCKETS x languages) from a bounded sample of labelled rows."""
    rows = sample(labelled(docs, F.lit(True) if usable is None else usable, key, text, lang))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            doc, bucket, _ = trigrams(batch.column(1).to_pylist())
            for name in sorted(set(langs)):
                b, n = np.unique(bucket[(langs == name)[doc]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    def dense(group: pa.Table) -> pa.Table:
        out = np.zeros(BUCKETS, dtype=np.int64)
        out[group.column("bucket").to_numpy()] = group.column("n").to_numpy()
        return pa.table([group.column("lang").slice(0, 1), pa.array([out.tobytes()], pa.binary())], names=["lang", "counts"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a language, BUCKETS numbers each
    found = sorted(sums.groupBy("lang").applyInArrow(dense, "lang string, counts binary").collect(), key=lambda r: r["lang"])
    counts = np.full((BUCKETS, len(found)), 0.05)
    for i, r in enumerate(found):
        counts[:, i] += np.frombuffer(r["counts"], dtype=np.int64)
    return [r["lang"] for r in found], np.log(counts / counts.sum(axis=0)) if found else counts


def infer(doc: np.ndarray, bucket: np.ndarray, n_docs: int, logp: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Proportions (documents x languages) of the best set of languages; zero rows for documents without trigrams.

    Penalised likelihood: log-likelihood less ``penalty`` times half the log
    of the number of trigrams for each language after the first, as in BIC.
    Languages leave in the order of their proportion in the full mixture.
    """
    k = logp.shape[1]
    out = np.zeros((n_docs, k))
    if not len(doc) or not k:
        return out
    code, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
    d, weight = code // BUCKETS, n.astype(np.float64)
    logs = logp[code % BUCKETS]
    top = logs.max(axis=1, keepdims=True)
    p, top = np.exp(logs - top), top[:, 0]
    starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    own, total = d[starts], np.add.reduceat(weight, starts)
    at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(d)]))

    def fit(allowed: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixtures of the allowed languages for some of the documents, and their log-likelihoods."""
        mine = some[at]
        pp, ww, tt = p[mine], weight[mine], top[mine]
        a = np.cumsum(some)[at[mine]] - 1
        s = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        pi = allowed[some] / allowed[some].sum(axis=1, keepdims=True)
        n_some = total[some][:, None]
        for _ in range(steps if k > 1 else 0):
            r = pp * pi[a]
            r *= (ww / r.sum(axis=1))[:, None]
            new = np.add.reduceat(r, s, axis=0) / n_some
            moved = np.abs(new - pi).max()
            pi = new
            if moved < 1e-3:
                break
        mix = np.maximum((pp * pi[a]).sum(axis=1), 1e-300)
        return pi, np.add.reduceat(ww * (np.log(mix) + tt), s)

    cost = penalty * 0.5 * np.log(np.maximum(total, 2.0))
    single = np.add.reduceat(weight[:, None] * logs, starts, axis=0)
    best_one = single.argmax(axis=1)
    score = single[np.arange(len(own)), best_one]
    chosen = np.eye(k)[best_one]
    if k > 1:
        everyone = np.ones(len(own), dtype=bool)
        full, likely = fit(np.ones((len(own), k)), everyone)
        open_ = likely - cost > score  # else no set of more languages can win
        order = np.argsort(-full, axis=1, kind="stable")
        for size in range(2, k + 1):
            if not open_.any():
                break
            allowed = np.zeros((len(own), k))
            np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
            pi, ll = fit(allowed, open_)
            value = ll - (size - 1) * cost[open_]
            better = value > score[open_]
            rows = np.flatnonzero(open_)[better]
            chosen[rows], score[rows] = pi[better], value[better]
            # nor can a larger one, where even the full likelihood wouldn't pay for another language
            open_[np.flatnonzero(open_)] &= likely[open_] - size * cost[open_] > score[open_]
    out[own] = chosen
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = 1.0) -> DataFrame:
    """docs without its text, with lang_pred, score (the language's proportion) and languages (those of the set).

    Null texts and texts without a letter, or a model without languages: 'und', 0.0
    and no languages.  Whole texts are read; rows stay as they are, repeated ones included.
    Own columns named lang_pred, score or languages are replaced.
    """
    added = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("languages", T.ArrayType(T.StringType()))
    kept = [c for c in docs.columns if c != text and c not in added.names]
    fields = T.StructType([docs.schema[c] for c in kept] + list(added))

    def rows(batch: pa.RecordBatch, said: list[str], score: np.ndarray, sets: list[list[str]]) -> pa.RecordBatch:
        more = [pa.array(said, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *more], names=[*kept, *added.names])

    return _each(docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).cast("string").alias("_gl_text")), len(kept), model, penalty, rows, fields)


def keep_determined(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", penalty: float = 1.0) -> DataFrame:
    """The rows of docs whose languages are determined, whatever the largest proportion; a model without languages says nothing, and all rows stay."""
    if not model[0]:
        return docs
    at = docs.columns.index(text)

    def rows(batch: pa.RecordBatch, said: list[str], score: np.ndarray, sets: list[list[str]]) -> pa.RecordBatch:
        return batch.filter(pa.array(np.array([s != UNDETERMINED for s in said], dtype=bool)))

    return _each(docs, at, model, penalty, rows, docs.schema)


def _each(docs: DataFrame, at: int, model: tuple[list[str], np.ndarray], penalty: float, rows, schema: T.StructType) -> DataFrame:
    """rows(batch, languages, scores, sets) of every batch of docs, whose texts are in column ``at``."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp.astype(np.float32)))  # bounded: BUCKETS x LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        table = table.astype(np.float64)
        for whole in batches:
            size = max(1, whole.column(at).nbytes // max(1, whole.num_rows))
            # a block holds its different trigrams (of one text BUCKETS at most) times the languages, several times
            step = max(1, (1 << 22) // max(4, len(names)) // size)
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                plain = [t or "" for t in batch.column(at).to_pylist()]
                doc, bucket, has = trigrams(plain)
                if not names:
                    has = np.zeros(len(plain), dtype=bool)
                mix = infer(doc, bucket, len(plain), table, penalty) if names else np.zeros((len(plain), 1))
                said = [names[j] if h else UNDETERMINED for j, h in zip(mix.argmax(axis=1), has, strict=True)]
                sets = [[names[j] for j in np.flatnonzero(m > 0)] if h else [] for m, h in zip(mix, has, strict=True)]
                yield rows(batch, said, np.where(has, np.minimum(mix.max(axis=1), 1.0), 0.0), sets)

    return docs.mapInArrow(run, schema)
