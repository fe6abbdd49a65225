"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and their log scores come from a SentencePiece model file, whatever
kind it was trained as.  A text gets a marker before it and one for each space;
the best-scoring split into pieces is found by dynamic programming over the
bytes, walking the trie from each character.  A character that no piece covers costs
the lowest score less UNKNOWN and is written as its bytes.  A marker character
that a text holds itself is written as bytes too, so that decoding restores every text.

No piece has a marker after another character, so a text's words are split
apart, equal words are encoded once, and a batch's new words go through the
trie together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_count import _rows

MARK = "▁"
UNKNOWN = 10.0
TABLE = 400_000
#: Stands for a marker character of the text itself while words are cut; a lone surrogate can't be in a text.
_OWN = "\ud800"


class DoubleArray:
    """A trie over bytes in two arrays: the child of node s by byte c is base[s] + c, if check says s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 16
        self.base, self.check, self.value = (np.full(size, v, dtype=np.int64) for v in (0, -1, -1))
        self.check[0] = 0
        free_from = 1
        queue = [(0, 0, len(keys), 0)]
        while queue:
            node, a, b, depth = queue.pop()
            while a < b and len(keys[a]) == depth:
                self.value[node] = values[a]
                a += 1
            if a == b:
                continue
            heads = [keys[i][depth] for i in range(a, b)]
            starts = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1])]
            labels = np.array([heads[i] for i in starts])
            at = 0
            look = free_from
            while not at:
                if look + 4096 + 512 > len(self.check):
                    grow = len(self.check)
                    self.base, self.check, self.value = (np.r_[x, np.full(grow, v, dtype=np.int64)] for x, v in ((self.base, 0), (self.check, -1), (self.value, -1)))
                free = np.flatnonzero(self.check[look : look + 4096] < 0) + look
                if len(free) < 64 and look == free_from:
                    free_from += 4096  # nearly full: not looked at again
                free = free[free > labels[0]] - labels[0]
                fits = (self.check[free[:, None] + labels] < 0).all(axis=1)
                at = int(free[fits.argmax()]) if fits.any() else 0
                look += 4096
            self.base[node] = at
            self.check[at + labels] = node
            for j, s in enumerate(starts):
                end = starts[j + 1] if j + 1 < len(starts) else len(heads)
                queue.append((at + int(labels[j]), a + s, a + end, depth + 1))


class Pieces:
    """A model's pieces, with Viterbi encoding of words and decoding of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, model.unk_id(), dtype=np.int64)
        self.out = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                b = int(text[i][3:5], 16)
                self.byte_ids[b] = i
                self.out[i] = bytes([b])
        for i in normal:
            self.out[i] = text[i].replace(MARK, " ").encode()
        if any(MARK in text[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a marker after another character")
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.floor = float(self.score[normal].min()) - UNKNOWN
        self.trie = DoubleArray([text[i].encode() for i in normal], normal)
        self.longest = max(len(text[i].encode()) for i in normal)
        self.pairs = {p[j : j + 2] for i in normal for p in (text[i],) for j in range(len(p) - 1)}
        self.first_byte = np.zeros(n, dtype=bool)
        self.first_byte[self.byte_ids] = True
        self.table: dict[str, bytes] = {}

    def _viterbi(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of one length in bytes."""
        length = len(words[0])
        x = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), length).astype(np.int64)
        best = np.full((length + 1, len(words)), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, len(words)), dtype=np.int64)
        piece = np.full((length + 1, len(words)), -1, dtype=np.int64)
        width = np.where(x < 0x80, 1, np.where(x < 0xE0, 2, np.where(x < 0xF0, 3, 4)))
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(length):
            rows = np.flatnonzero((best[i] > -np.inf) & ((x[:, i] & 0xC0) != 0x80))
            if not len(rows):
                continue
            state = np.zeros(len(rows), dtype=np.int64)
            single = np.zeros(len(words), dtype=bool)
            who = rows
            for j in range(i, min(length, i + self.longest)):
                to = base[state] + x[who, j]
                ok = (check[to] == state) & (base[state] > 0)
                who, state = who[ok], to[ok]
                if not len(who):
                    break
                ids = value[state]
                hit = ids >= 0
                w, ids = who[hit], ids[hit]
                if len(w):
                    single[w[j - i + 1 == width[w, i]]] = True
                    s = best[i, w] + self.score[ids]
                    better = s > best[j + 1, w]
                    w, ids, s = w[better], ids[better], s[better]
                    best[j + 1, w], back[j + 1, w], piece[j + 1, w] = s, i, ids
            bare = rows[~single[rows]]
            for k in (1, 2, 3, 4):
                w = bare[width[bare, i] == k]
                if len(w) and i + k <= length:
                    s = best[i, w] + self.floor
                    better = s > best[i + k, w]
                    w, s = w[better], s[better]
                    best[i + k, w], back[i + k, w], piece[i + k, w] = s, i, -1
        out = []
        back, piece = back.T.tolist(), piece.T.tolist()
        for r, word in enumerate(words):
            at, ids = length, []
            while at:
                b, p = back[r][at], piece[r][at]
                if p < 0:
                    ids += self.byte_ids[np.frombuffer(word[b:at], dtype=np.uint8)].tolist()[::-1]
                else:
                    ids.append(p)
                at = b
            out.append(np.array(ids[::-1], dtype="<u4").tobytes())
        return out

    def _learn(self, words: set[str]) -> None:
        parts: dict[str, list[str]] = {}
        for w in words:
            if len(w) <= 48 and _OWN not in w:
                parts[w] = [w]
                continue
            # characters that no piece has side by side are apart in any split
            cuts = [0, *(j for j in range(1, len(w)) if w[j - 1 : j + 1] not in self.pairs), len(w)]
            parts[w] = [w[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        by_length: dict[int, list[str]] = {}
        done: dict[str, bytes] = {_OWN: self.byte_ids[np.frombuffer(MARK.encode(), dtype=np.uint8)].astype("<u4").tobytes()}
        for p in {p for ps in parts.values() for p in ps} - {_OWN}:
            by_length.setdefault(len(p.encode()), []).append(p)
        for same in by_length.values():
            step = max(1, (1 << 21) // len(same[0].encode()))
            for a in range(0, len(same), step):
                some = same[a : a + step]
                done.update(zip(some, self._viterbi([p.encode() for p in some]), strict=True))
        for w, ps in parts.items():
            self.table[w] = done[ps[0]] if len(ps) == 1 else b"".join([done[p] for p in ps])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; an empty text has none."""
        cut = _WORDS.findall
        for at in range(0, len(texts), 128):
            some = [cut((MARK + t.replace(MARK, _OWN).replace(" ", MARK)) if t else "") for t in texts[at : at + 128]]
            words = set().union(*some)
            if new := words - self.table.keys():
                if len(self.table) + len(new) > TABLE:
                    self.table.clear()
                    new = words
                self._learn(new)
            table = self.table
            for ws in some:
                yield b"".join([table[w] for w in ws])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of ids: markers become spaces, byte pieces bytes, and the marker before the text goes."""
        whole = b"".join([self.out[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return whole[1:] if whole[:1] == b" " else whole


#: A line feed is in no piece but its byte's; neither is a marker after another character.
_WORDS = regex.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary, little-endian 32-bit; null text: null) for every row; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for a, b in _rows(batch, 1 << 22):
                texts = batch.column(1).slice(a, b - a).to_pylist()
                ids = [None if t is None else x for t, x in zip(texts, model.encode([t or "" for t in texts]), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text for every row of encode()'s result (null ids: null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for a, b in _rows(batch, 1 << 22):
                texts = [None if x is None else model.decode(x).decode() for x in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], names=["key", "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_pieces, n_byte_pieces, ids_crc32, round_trip (decoding gives the text), in one pass; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for a, b in _rows(batch, 1 << 22):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                rows = []
                for t, x in zip(texts, model.encode(texts), strict=True):
                    raw = t.encode()
                    rows.append((len(raw), len(x) >> 2, int(model.first_byte[np.frombuffer(x, "<u4")].sum()), zlib.crc32(x), model.decode(x) == raw))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(list(c)) for c in zip(*rows, strict=True))], names=["key", "n_bytes", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean").withColumnRenamed("key", key)
