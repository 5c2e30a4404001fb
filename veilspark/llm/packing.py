"""Packing into fixed-length sequences along a space-filling curve.

Every document becomes its token ids with an end id.  Its hashed vector of
token counts is projected on three fixed random directions; the cell's place
on a Hilbert curve is its key, so documents of like content lie near each
other.  The tokenised table is written once and range-sorted by (key, id, a
written random number), so even many equal documents spread over tasks.  Each
task fills sequences with its documents in order and cuts them where a
sequence is full; what is left at its end is cut into sequences of powers of
two, which need no padding.

Ids are those of the library.  Plain Latin texts are normalised and split
here, and the library's model gives the ids of each new word; any other text,
and one that may hold a special string, goes to the library whole.

Defined results: null and empty texts are their end id alone.  Repeated rows
are packed each.  An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, byte_chars, small_batches

LENGTH = 2048
TASK_TOKENS = 8_000_000
_DIMS, _BITS, _BUCKETS = 3, 16, 256
_KEPT = 700_000  # words whose ids are kept; beyond it the table starts anew
# As in the file's own pattern; white space by its property.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def _plain(text: str) -> bool:
    """Latin throughout, without the controls that str.split() takes for white space and the library does not."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return not ((c > 0x36F) | (c - 0x1C < 4)).any()


class Ids(dict):
    """Texts -> ids as little-endian bytes; the table holds word -> ids.

    A piece never holds white space, so the ids of a plain text are those of
    its words in turn.  A new word is cut into pieces, whose ids are the
    library's model's."""

    def __init__(self, spec: str):
        super().__init__()
        self.tok = Tokenizer.from_str(spec)
        self.model = self.tok.model
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.chars = str.maketrans(byte_chars())
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def _piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.chars))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            out = self._piece(word)
        elif word[:-1].isalpha() and not word[-1].isalnum():
            out = self[word[:-1]] + self[word[-1]]
        else:
            out = b"".join(map(self._piece, _PIECES.findall(word)))
        self[word] = out
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def of(self, text: str) -> bytes:
        if not _plain(text) or any(s in text for s in self.special):
            return self.whole(text)
        if len(self) > _KEPT:
            self.clear()
        return b"".join(map(self.__getitem__, unicodedata.normalize("NFC", text).lower().split()))


def _directions() -> np.ndarray:
    return np.random.RandomState(8).choice([-1.0, 1.0], size=(_BUCKETS, _DIMS))


def hilbert_keys(cells: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates (transposed form, then interleaved)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document from its hashed token counts."""
    m = np.stack([np.bincount(i % _BUCKETS, minlength=_BUCKETS) for i in ids]).astype(np.float64)
    m = np.log1p(m)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    top = (1 << _BITS) - 1
    cells = np.clip((m @ _directions() + 4) / 8 * top, 0, top).astype(np.int64)
    return hilbert_keys(cells)


def _cut_rest(used: int) -> list[int]:
    """Powers of two, largest first, that sum to ``used``."""
    return [1 << b for b in range(used.bit_length() - 1, -1, -1) if used >> b & 1]


def pack_rows(rows: Iterator[tuple[object, np.ndarray]], length: int = LENGTH) -> Iterator[tuple]:
    """(doc_id, ids) in order -> pieces ``(doc_id, start, ids, doc_tokens, sequence, offset)``.

    Holds the pieces of one unfinished sequence."""
    sequence, held, used = 0, [], 0
    for doc, ids in rows:
        start = 0
        while start < len(ids):
            part = ids[start:start + length - used]
            held.append((doc, start, part, len(ids)))
            start += len(part)
            used += len(part)
            if used == length:
                at = 0
                for d, s, p, n in held:
                    yield d, s, p, n, sequence, at
                    at += len(p)
                sequence, held, used = sequence + 1, [], 0
    sizes = _cut_rest(used)
    at = 0
    for d, s, p, n in held:
        while len(p):
            part = p[:sizes[0] - at]
            yield d, s, part, n, sequence, at
            s, p, at = s + len(part), p[len(part):], at + len(part)
            if at == sizes[0]:
                sizes, sequence, at = sizes[1:], sequence + 1, 0


_known: dict[int, Ids] = {}


def tokenise(df: DataFrame, tokenizer_file: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc, ids, n, key, tie)``: ids as bytes, the Hilbert key, a random number against ties."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    sent = df.sparkSession.sparkContext.broadcast(spec)
    which = hash(spec)

    @F.pandas_udf("ids binary, n int, key long")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if which not in _known:
            _known.clear()
            _known[which] = Ids(sent.value)
        get = _known[which]
        end = np.array([end_id], get.type).tobytes()
        for s in batches:
            raw = [x + end for x in map(get.of, [t or "" for t in s])]
            arrays = [np.frombuffer(r, get.type) for r in raw]
            keys = curve_keys(arrays) if raw else []
            yield pd.DataFrame({"ids": raw, "n": [len(a) for a in arrays], "key": keys})

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("doc"), ids(F.col(text_col)).alias("t")).select(
        "doc", "t.ids", "t.n", "t.key", F.rand(8).alias("tie"))


def pack(df: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
         length: int = LENGTH, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Pieces ``(id_col, start, length, ids, doc_tokens, sequence_id, offset)``;
    ``ids`` as little-endian unsigned 32-bit integers.  ``length`` is a power of two."""
    scratch = Scratch(df.sparkSession, "packing")
    table = scratch.cut(tokenise(df, tokenizer_file, end_id, id_col, text_col))
    total = table.agg(F.sum("n")).first()[0] or 0
    with open(tokenizer_file, encoding="utf-8") as f:
        wide = Ids(f.read()).type
    ordered = table.repartitionByRange(max(1, -(-total // task_tokens)), "key", "doc", "tie").sortWithinPartitions("key", "doc", "tie")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()

        def rows():
            for pdf in batches:
                # None stays None: ids of any type pass through as they are
                for doc, raw in zip(pdf["doc"].astype(object), pdf["ids"], strict=True):
                    yield (None if pd.isna(doc) else doc), np.frombuffer(raw, wide)

        out = []
        for doc, start, part, n, sequence, at in pack_rows(rows(), length):
            out.append((doc, start, len(part), part.astype("<u4").tobytes(), n, (task << 32) + sequence, at))
            if len(out) == 512:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kind = table.schema["doc"].dataType.simpleString()
    small_batches(df.sparkSession)
    pieces = ordered.select("doc", "ids").mapInPandas(
        fill, f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("doc", id_col)
