"""URL filter: rules first, then gradient-boosted trees on lexical features.

URLs that a rule decides are the labelled ones.  A bounded sample of them
trains boosted trees on length, depth, digit ratio, entropy, parameter counts
and smoothed block rates of host suffixes; the trees judge all other URLs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trees are fitted on at most this many distinct labelled URLs, chosen by hash.
SAMPLE = 20_000
#: Suffix rates of a training row come from the other folds, so that they don't tell its own label.
FOLDS = 5
#: (verdict, host suffix and path prefix)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(F.translate(host, _UPPER, _LOWER)), empty(path)


def with_rule(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule (null where none fits) and rule_verdict; the longest fitting rule wins."""
    host, path = host_and_path(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(f"/{p}"))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return parsed.withColumns({"rule": rule, "rule_verdict": verdict})


def suffixes(hosts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The last label of each host, and the last two."""
    return pc.replace_substring_regex(hosts, r"(?s)^.*\.", ""), pc.replace_substring_regex(hosts, r"(?s)^.*\.([^.]*\.[^.]*)$", r"\1")


def entropy(urls: pa.Array) -> np.ndarray:
    """Bits per character."""
    sizes = pc.utf8_length(urls).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(urls.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    code, n = np.unique(row << 21 | points.astype(np.int64), return_counts=True)
    whole = sizes[code >> 21]
    return np.bincount(code >> 21, n / whole * np.log2(whole / n), minlength=len(sizes))


def lexical(urls: pa.Array, hosts: pa.Array) -> np.ndarray:
    """Length, host length, depth, dots, digit ratio, digits in the host, entropy, parameters, dashes in the host."""
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
    n = number(pc.utf8_length(urls))
    plain = pc.replace_substring_regex(urls, r"(?s)#.*$", "")
    path = pc.replace_substring_regex(pc.replace_substring_regex(plain, r"(?s)\?.*$", ""), r"(?s)^.*?://[^/]*", "")
    query = pc.replace_substring_regex(plain, r"(?s)^[^?]*\??", "")
    count = lambda x, c: number(pc.count_substring(x, c))
    digits = lambda x: number(pc.count_substring_regex(x, r"\p{Nd}"))
    return np.column_stack([n, number(pc.utf8_length(hosts)), count(path, "/"), count(hosts, "."), digits(urls) / np.maximum(n, 1), digits(hosts), entropy(urls), count(query, "="), count(hosts, "-")])


def suffix_rates(hosts: pa.Array, y: np.ndarray, smooth: float = 20.0) -> tuple[pa.Array, np.ndarray, float]:
    """Suffixes, their block rates drawn towards the rate of all, and that rate."""
    prior = float(y.mean()) if len(y) else 0.0
    top, two = suffixes(hosts)
    same = pc.equal(top, two).to_numpy(zero_copy_only=False)
    names, at = np.unique(np.array(top.to_pylist() + two.filter(pa.array(~same)).to_pylist(), dtype=object), return_inverse=True)
    labels = np.r_[y, y[~same]]
    n, blocked = np.bincount(at, minlength=len(names)), np.bincount(at, labels, minlength=len(names))
    return pa.array(names, pa.string()), (blocked + smooth * prior) / (n + smooth), prior


def rates_of(hosts: pa.Array, rates: tuple[pa.Array, np.ndarray, float]) -> np.ndarray:
    names, values, prior = rates

    def look_up(x: pa.Array) -> np.ndarray:
        at = pc.fill_null(pc.index_in(x, value_set=names), -1).to_numpy(zero_copy_only=False)
        return np.where(at >= 0, np.r_[values, prior][at], prior)

    return np.column_stack([look_up(x) for x in suffixes(hosts)])


class Trees:
    """Boosted regression trees for log-loss, on binned features; deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, leaf: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            at = np.zeros(len(y), dtype=np.int64)
            for node in range(len(tree)):
                mine = np.flatnonzero(at == node)
                if not len(mine):
                    continue
                gs, hs = g[mine].sum(), h[mine].sum()
                best = (1e-6, -1, 0)
                if node < 2**self.depth - 1 and len(mine) >= 2 * self.leaf:
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[mine, f]
                        gl = np.cumsum(np.bincount(b, g[mine], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[mine], len(e) + 1))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(nl < self.leaf) | (len(mine) - nl < self.leaf)] = -1
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (float(gain[k]), f, k)
                if best[1] < 0:
                    tree[node] = (-1, 0.0, self.rate * gs / (hs + 1))
                    z[mine] += tree[node][2]
                else:
                    _, f, k = best
                    tree[node] = (f, float(edges[f][k]), 0.0)
                    at[mine] = 2 * node + 1 + (binned[mine, f] > k)
            self.trees.append(tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.trees:
            f = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            value = np.array([t[2] for t in tree])
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                inner = f[at] >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f[at], 0)] >= cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            z += value[at]
        return 1 / (1 + np.exp(-z))


def fit(urls: list[str], hosts: list[str], blocked: np.ndarray) -> tuple[tuple, Trees | None]:
    """The model: suffix rates, and trees (None without labelled rows, which allows everything)."""
    u, h = pa.array(urls, pa.string()), pa.array(hosts, pa.string())
    rates = suffix_rates(h, blocked)
    if not len(urls):
        return rates, None
    fold, near = np.arange(len(urls)) % FOLDS, np.zeros((len(urls), 2))
    for f in range(FOLDS):
        near[fold == f] = rates_of(h.filter(pa.array(fold == f)), suffix_rates(h.filter(pa.array(fold != f)), blocked[fold != f]))
    return rates, Trees().fit(np.column_stack([lexical(u, h), near]), blocked)


def score(urls: pa.Array, hosts: pa.Array, model: tuple[tuple, Trees]) -> np.ndarray:
    return model[1].score(np.column_stack([lexical(urls, hosts), rates_of(hosts, model[0])]))


def sample_of(labelled: DataFrame, url: str, size: int) -> DataFrame:
    """About ``size`` of the distinct rows (all, if there are fewer), by a hash of the URL: filtered before any shuffle, so that
    what reaches the driver doesn't grow with the table.  Copies of a URL count once, so that none fills the sample."""
    h = F.xxhash64(url)
    n = labelled.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    part = labelled if n <= size else labelled.where(F.pmod(h, F.lit(1 << 32)) < int((1 << 32) * size / n))
    return part.distinct()


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """key, host, path, rule, verdict, score (estimated probability of block; 1 or 0 by rule).

    A null URL and one without :// have empty host and path; the trees judge
    them like others.  Repeated rows stay; other columns are not read.  Very
    long URLs are read whole; without labelled URLs all others are allowed.
    """
    ruled = with_rule(pages.select(F.col(key).alias("_gl_key"), F.col(url).cast("string").alias("_gl_url")), "_gl_url", rules)
    labelled = ruled.where(F.col("rule").isNotNull()).select("_gl_url", "host", "rule_verdict")
    rows = sorted(sample_of(labelled, "_gl_url", sample).select(F.xxhash64("_gl_url"), "_gl_url", "host", "rule_verdict").collect())[:sample]
    model = fit([r[1] for r in rows], [r[2] for r in rows], np.array([r[3] == "block" for r in rows], dtype=float))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pc.fill_null(pc.equal(batch.column(5), "block"), False).to_numpy(zero_copy_only=False).astype(np.float64)
            open_ = pc.is_null(batch.column(4))
            if shared.value[1] is not None and pc.any(open_).as_py():
                urls, hosts = (pc.fill_null(batch.column(i).filter(open_), "") for i in (1, 2))
                said[open_.to_numpy(zero_copy_only=False)] = score(urls, hosts, shared.value)
            verdict = np.where(said >= 0.5, "block", "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(verdict.tolist(), pa.string()), pa.array(said)], names=["key", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema[key].dataType.simpleString()
    cols = ruled.select("_gl_key", "_gl_url", "host", "path", "rule", "rule_verdict")
    return cols.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("key", key)
