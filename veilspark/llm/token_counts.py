"""Token counts by a compiled finite-state transducer, for byte-level BPE files.

Two deterministic machines, annotated with counts:

* the splitter reads character classes and a window of one character back and
  three ahead, and marks where a pre-token starts (evaluated for all positions
  of a chunk at once);
* the merger reads a pre-token's bytes.  Its state is the longest suffix read
  that begins some token, with the last token and the relative token count at
  each position of that suffix; that is all that later bytes can depend on,
  since a token sequence is the BPE result exactly if each adjacent pair is.
  A transition carries the change of the token count (which may be negative:
  tokens read so far may merge).  States are made when first reached.

A text is cut into chunks anywhere.  A chunk's map from entry state to (exit
state, count) is held in a finite form: what stands before its first
synchronising position (a white space after something else, where a new
pre-token starts whatever came before), the count between the first and the
last one, and what stands after it.  Maps compose associatively and are
combined pairwise, level by level.

Defined results: null counts as empty; an empty text has 0 tokens; special
strings of the file count as one token each where they occur, as in the
library.  Repeated rows are counted each on their own; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from .common import fresh, small_batches

CHUNK = 1 << 16  # characters of a chunk
_CACHED = 300_000  # pre-tokens whose counts are kept; beyond it the table starts anew
_MOVES = 300_000  # transitions kept; likewise

# Character classes.
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# The code points of the White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        kind = {"L": _LETTER, "N": _NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        newer = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for pattern, k in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for m in regex.finditer(pattern, every):
                newer[m.start():m.end()] = k
        # Where two Unicode versions differ, the tokenizers library says what it takes a character for.
        split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in np.flatnonzero(t != newer):
            starts = [p[1][0] for p in split(f"a{chr(c)}1")]
            t[c] = _LETTER if 1 not in starts else _NUMBER if 2 not in starts else _OTHER
        t[_WHITE] = _SPACE
        _classes = t
    return _classes


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_starts(text: str) -> np.ndarray:
    """Positions at which the splitter starts a pre-token."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cps)
    kind = _class_table()[cps]
    white = kind == _SPACE
    start = np.ones(n, bool)
    if n > 1:
        was_white, now = white[:-1], white[1:]
        # Others: after white space unless a plain space joins them, else where the class changes.
        other = np.where(was_white, cps[:-1] != 32, kind[1:] != kind[:-1])
        # White space: where it begins, and its last character if something follows.
        last = np.zeros(n - 1, bool)
        last[:-1] = ~white[2:]
        start[1:] = np.where(now, ~was_white | last, other)
        # Contractions: an apostrophe that starts a pre-token takes s, t, m, d, re, ve or ll with it.
        for i in np.flatnonzero((cps == 39) & start):
            two = text[i + 1:i + 3]
            size = 2 if two[:1] and two[0] in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if size:
                start[i + 1:i + size] = False
                if i + size < n:
                    start[i + size] = True
    return np.flatnonzero(start)


class CountingTransducer:
    """Counts the tokens of texts for one byte-level BPE file (its JSON text)."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"] for t in j["added_tokens"]]
        special = set(self.special)
        self.tokens = {raw(s): i for s, i in j["model"]["vocab"].items() if s not in special}
        self.ranks = {}
        for r, m in enumerate(j["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[raw(a), raw(b)] = r
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t) + 1)}
        self.own: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.chunks_ok = not any(c.isspace() for s in self.special for c in s)
        self._restart()
        self.counts: dict[str, int] = {}

    def _restart(self) -> None:
        # state 0: nothing read; the "last token" before the first byte is empty
        self.states: list[tuple[bytes, tuple[bytes, ...], tuple[int, ...]]] = [(b"", (b"",), (0,))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes, edge: int = 0) -> list[bytes] | None:
        """Plain BPE: the pair of least rank first, leftmost first.  None as soon
        as a pair is merged across ``edge`` (0: none is)."""
        parts = [data[i:i + 1] for i in range(len(data))]
        rank, none = self.ranks.get, 1 << 60
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            if i < edge:
                edge -= 1
                if i == edge:
                    return None
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            # only the pairs with the new part have other ranks
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _whole(self, t: bytes) -> bool:
        """Whether the token stands for its own bytes."""
        ok = self.own.get(t)
        if ok is None:
            ok = self.own[t] = self.merge(t) == [t]
        return ok

    def _adjacent(self, a: bytes, b: bytes) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > _MOVES:
                self.pairs.clear()
            ok = self.pairs[a, b] = not a or self.merge(a + b, len(a)) == [a, b]
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Make the transition: (next state, change of the count)."""
        read, last, count = self.states[state]
        read += bytes([byte])
        for k in range(len(read)):  # longest token first; exactly one fits
            t = read[k:]
            if t in self.tokens and self._whole(t) and self._adjacent(last[k], t):
                break
        change = count[k] + 1 - count[-1]
        last, count = (*last, t), (*count, count[k] + 1)
        while read not in self.prefixes:
            read = read[1:]
        last, count = last[-len(read) - 1:], count[-len(read) - 1:]
        key = (read, last, tuple([c - count[-1] for c in count]))
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.states)
            self.states.append(key)
        self.moves[state << 8 | byte] = n, change
        return n, change

    def _pretoken(self, text: str) -> int:
        if len(self.moves) > _MOVES:
            self._restart()
        state = total = 0
        moves = self.moves
        for b in text.encode("utf-8", "surrogatepass"):
            m = moves.get(state << 8 | b)
            state, change = m if m else self._move(state, b)
            total += change
        return total

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        at = token_starts(text).tolist()
        counts = self.counts
        pieces = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
        found = [*map(counts.get, pieces)]
        if None in found:
            new: dict[str, int] = {}
            for i, p in enumerate(pieces):
                if found[i] is None:
                    n = new.get(p)
                    found[i] = n if n is not None else new.setdefault(p, self._pretoken(p))
            if len(counts) > _CACHED:
                counts.clear()
            counts.update(new)
        return sum(found)

    def complete(self, text: str) -> int:
        """Tokens of a whole text, special strings as one token each."""
        parts = [text]
        n = 0
        for s in self.special:
            split = [p.split(s) for p in parts]
            n += sum(len(p) - 1 for p in split)
            parts = [x for p in split for x in p]
        return n + sum(self._plain(p) for p in parts)

    # -- chunk maps ---------------------------------------------------------
    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(before the first synchronising position, count up to the last one,
        the rest); (chunk, None, "") if there is none."""
        kind = _class_table()[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sync = np.flatnonzero((kind[1:] == _SPACE) & (kind[:-1] != _SPACE)) + 1
        if not len(sync):
            return chunk, None, ""
        a, b = int(sync[0]), int(sync[-1])
        return chunk[:a], self.complete(chunk[a:b]), chunk[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The map of two neighbouring chunks."""
        if x[1] is None and y[1] is None:
            if x[0] and y[0] and not x[0][-1].isspace() and _class_table()[ord(y[0][0])] == _SPACE:
                return x[0], 0, y[0]  # the seam synchronises
            return x[0] + y[0], None, ""
        if x[1] is None:
            return x[0] + y[0], y[1], y[2]
        if y[1] is None:
            return x[0], x[1], x[2] + y[0]
        return x[0], x[1] + self.complete(x[2] + y[0]) + y[1], y[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk or not self.chunks_ok:
            return self.complete(text)
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:  # a level of the scan
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.complete(head) + (n or 0) + self.complete(tail)


_machines: dict[int, CountingTransducer] = {}


def count_tokens(df: DataFrame, tokenizer_file: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` plus the number of tokens of the whole text.  ``tokenizer_file``
    (byte-level BPE, JSON) is read here and sent to the tasks."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    sent = df.sparkSession.sparkContext.broadcast(spec)
    key = hash(spec)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _machines:
            _machines.clear()
            _machines[key] = CountingTransducer(sent.value)
        machine = _machines[key]
        for s in batches:
            yield pd.Series([machine.count(x) if x else 0 for x in s], dtype="int64")

    small_batches(df.sparkSession)
    tmp, = fresh(df, "_tokens")
    keep = [c for c in df.columns if c != out]
    return df.withColumn(tmp, tokens(F.col(text_col))).select(*keep, F.col(tmp).alias(out))
