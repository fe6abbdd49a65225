"""Token counts with a whole-token shortcut, and token ids from the same tables.

prove() shows, once per vocabulary, which of its strings encode alone as
exactly one token: those need no merging wherever they stand as a pre-token.
A text is cut at the six ASCII separators, which the tokenizer drops and which
no normalization, pre-token or special token of it crosses; each piece is
counted through a table of pieces seen before.  A new piece is cut into its
pre-tokens: proven ones are counted directly, and only the others go through
the library's merges.  Texts that may hold a special token are left to the library as a whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces remembered by a worker before its table starts anew; about 120 bytes each.
TABLE = 400_000
_workers: dict[str, "Counter"] = {}


def prove(tokenizer, vocab: dict[str, int], suffix: str) -> dict[str, int]:
    """Strings of the vocabulary that end a word, are one pre-token, and encode alone as that one token."""
    alphabet = _byte_chars()
    ids, texts = [], []
    for piece, i in vocab.items():
        if not piece.endswith(suffix):
            continue
        try:
            text = bytes(alphabet[c] for c in piece[: len(piece) - len(suffix)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text and not text.isspace():
            ids.append(i)
            texts.append(text)
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return {t: i for t, i, e in zip(texts, ids, found, strict=True) if e.ids == [i]}


def _byte_chars() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Counter:
    """Ids of texts by one vocabulary file, with the shortcut's tables; one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex

        self.short = False
        self.marks: list[bytes] = []
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.whole = lambda text: model.encode(text)
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        if steps != ["NFC", "Replace", "Lowercase"] or not suffix:
            return  # this vocabulary keeps case or white space: the library reads whole texts
        self.short = True
        # how special tokens start: texts that hold it are left to the library
        self.marks = sorted({t["content"][:2].encode() for t in spec["added_tokens"]})
        cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        proven = {t: np.uint32(i).tobytes() for t, i in prove(self.tokenizer, spec["model"]["vocab"], suffix).items()}
        shown = {b: c for c, b in _byte_chars().items()}
        merge = self.tokenizer.model.tokenize

        def learn(piece: bytes) -> bytes:
            """Ids of a new piece: proven pre-tokens directly, the others by merging."""
            text = piece.decode()
            if not text.isprintable() or not (text.isascii() or (text == text.lower() and max(text) <= "\xff")):
                # Latin-1 is composed already; what else normalization could change goes through the library
                return array("I", self.whole(text)).tobytes()
            if text.isalpha():
                parts = (text,)
            elif text[-1] in ".,;:!?" and text[:-1].isalpha():
                parts = (text[:-1], text[-1])
            else:
                parts = cut(text)
            out = b""
            for t in parts:
                ids = proven.get(t)
                if ids is None:
                    ids = array("I", [m.id for m in merge(t if t.isascii() else t.encode().decode("latin-1").translate(shown))]).tobytes()
                out += ids
            return out

        self.proven = proven
        self.table = _Table(learn)

    def ids(self, raws: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text; null: none."""
        for raw in raws:
            if not raw:
                yield b""
            elif self.short and not any(m in raw for m in self.marks):
                yield b"".join(map(self.table.__getitem__, raw.lower().split()))
            else:
                yield np.array(self.whole(raw.decode()), dtype="<u4").tobytes()


class _Table(dict):
    """Pieces seen lately; it starts anew when it is full."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= TABLE:
            self.clear()
        ids = self[piece] = self.learn(piece)
        return ids


def counter(path: str) -> Counter:
    if path not in _workers:
        _workers[path] = Counter(path)
    return _workers[path]


def _rows(batch: pa.RecordBatch, most: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Spans of rows with at most about `most` bytes of text, or one row."""
    n, start = batch.num_rows, 0
    size = max(1, batch.nbytes // max(1, n))
    step = max(1, most // size)
    while start < n:
        yield start, min(n, start + step)
        start += step


def count(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row; null text counts as empty.

    Repeated rows stay repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            for a, b in _rows(batch):
                raws = batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist()
                tokens = np.fromiter((len(x) >> 2 for x in tool.ids(raws)), dtype=np.int64, count=len(raws))
                sizes = np.fromiter((len(r) if r else 0 for r in raws), dtype=np.int64, count=len(raws))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
