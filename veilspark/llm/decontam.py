"""Benchmark decontamination by template windows.

Texts are brought to a template: words without the punctuation around them, in
lower case; numbers (also in words), names (words with capitals) and units
(after a number) become typed placeholders.  A window of ``WINDOW`` template
words with fewer than ``LITERALS`` plain words stands for itself, so that runs
of placeholders do not meet.  Windows are filed under several readings: a
capitalised word that opens a sentence as name and as plain word; names also
as plain words, for texts that lost their capitals; and names of several words
also as one slot, with and without the word that opens the sentence, so that
names of different lengths keep the alignment.

The items' windows are a table (hash, item, position).  A whole batch of
documents is read as one array; windows whose hash prefix no item has, by a
bitmap of ``FILTER_BITS`` bits, are left out, the others are joined with the
items' windows and counted by (text, item, alignment).  Pairs of text and item
with enough windows on one alignment are then checked slot by slot: the item's
numbers, names and units must map one to one to the document's.  An item is
found where, in some stretch of ``STRETCH`` words of it (all of a shorter
item), at least the share ``similarity`` of the windows hits.  So verbatim
copies, re-parameterised questions and long excerpts count, a few common words
do not.

Neither items nor hits pass through the driver, only the bitmap does; equal
texts are one text.

Defined results: null and empty texts contain nothing, null or empty items are
found nowhere; items shorter than a window are one window of all their words.
Repeated rows give their hits each; repeated items by each of their ids.
Empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches

WINDOW = 5
STRETCH = 13
LITERALS = 2
SIMILARITY = 0.8
FILTER_BITS = 24

# Units that follow a number.
UNITS = frozenset("km m cm mm mi mile miles ft foot feet inch inches yard yards kg g mg lb lbs pound pounds oz ounce ounces ton tons "
                  "l ml liter liters litre litres gallon gallons h hr hrs hour hours min mins minute minutes s sec secs second seconds day days "
                  "week weeks month months year years dollar dollars euro euros cent cents usd eur gbp percent degree degrees "
                  "kmh mph kb mb gb tb w kw v a hz khz mhz ghz".split())
# Numbers in words.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split())
_LITERAL, _NUMBER, _NAME, _UNIT, _OPENING = 0, 1, 2, 3, 4  # a capitalised word that opens its sentence is a name or none
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_DIGITS = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
_NUMBER_UNIT = re.compile(r"(\d+(?:[.,]\d+)*)([^\W\d_]+)")
_KEPT = 600_000  # words whose readings are kept; beyond it the table starts anew
_MULT = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


_KIND = dict.fromkeys(NUMBERS, _NUMBER) | dict.fromkeys(UNITS, _UNIT)
_hash = xxhash.xxh64_intdigest


_PLACEHOLDER = np.array([0, _hash("<number>"), _hash("<name>"), _hash("<unit>"), _hash("<name>")], np.uint64)


_LINE = "\0"  # stands for a line end among the words
_BREAK, _SKIP, _PAIR = 9, 8, 7  # kinds of entries that stand for a line end, for nothing and for two


class Reader(dict):
    """Word -> number of its entry; a table of the words met, filled as they come.

    An entry has the hash of the plain word, its kind, whether it is
    capitalised and whether it ends its sentence."""

    def __init__(self):
        super().__init__()
        self.n = 0
        # hash of the plain word; kind (a unit only after a number); capitalised; ends its sentence
        self.hash, self.kind, self.title, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, bool)
        self.new: list[tuple[int, int, bool, bool]] = []
        self.pairs: dict[int, tuple[int, int]] = {}
        self[_LINE] = self._entry("", _BREAK, False, True)
        self.skip = self._entry("", _SKIP, False, False)

    def __missing__(self, word: str) -> int:
        out = self[word] = self._read(word)
        return out

    def _entry(self, plain: str, kind: int, title: bool, ends: bool) -> int:
        self.new.append((_hash(plain), kind, title, ends))
        self.n += 1
        return self.n - 1

    def _settle(self) -> None:
        """The entries of new words go to the arrays."""
        if self.new:
            cols = (np.array(c, old.dtype) for c, old in zip(zip(*self.new, strict=True), (self.hash, self.kind, self.title, self.ends), strict=True))
            self.hash, self.kind, self.title, self.ends = map(np.append, (self.hash, self.kind, self.title, self.ends), cols)
            self.new = []

    def _word(self, core: str, ends: bool) -> int:
        plain = core.lower()
        kind = _KIND.get(plain, _LITERAL)
        if kind == _LITERAL and "-" in plain and NUMBERS.issuperset(plain.split("-")):
            kind = _NUMBER
        # a single capital is more often a pronoun or an article
        self.new.append((_hash(plain), kind, core != plain and len(core) > 1, ends))
        self.n += 1
        return self.n - 1

    def _read(self, word: str) -> int:
        """Entry of one word: the skipped one for bare punctuation, a pair for a number with its unit."""
        if word.isalpha():
            return self._word(word, False)
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return self._word(word[:-1], word[-1] != ",")
        m = _CORE.search(word)
        if not m:
            return self.skip
        core, ends = m[0], bool(re.search(r"[.!?:;]", word[m.end():]))
        plain = core.lower()
        both = _NUMBER_UNIT.fullmatch(plain)
        if _DIGITS.fullmatch(plain):
            return self._entry(plain, _NUMBER, False, ends)
        if both and both[2] in UNITS:
            both_of = self._entry(plain, _PAIR, False, ends)
            self.pairs[both_of] = self._entry(both[1], _NUMBER, False, False), self._entry(both[2], _UNIT, False, ends)
            return both_of
        return self._word(core, ends)

    def template(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the plain words, kinds) of a whole text."""
        return self.templates([text])[:2]

    def templates(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The templates of several texts, one after the other, and the text each word is of."""
        if len(self) > _KEPT:
            self.clear()
            self.__init__()
        # A sentence also ends with its line.
        parts = [(t or "").replace("\n", f" {_LINE} ").split() for t in texts]
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        i = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, len(of))
        self._settle()
        pair = self.kind[i] == _PAIR
        if pair.any():
            i = np.array([x for e in i.tolist() for x in self.pairs.get(e, (e,))], np.int64)
            of = np.repeat(of, np.where(pair, 2, 1))
        real = self.kind[i] != _SKIP
        i, of = i[real], of[real]
        first = np.ones(len(i), bool)
        first[1:] = self.ends[i[:-1]] | (of[1:] != of[:-1])
        real = self.kind[i] != _BREAK
        i, of, first = i[real], of[real], first[real]
        if not len(i):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), of
        k = self.kind[i]
        k[(k == _UNIT) & ~np.concatenate([[False], (k[:-1] == _NUMBER) & (of[1:] == of[:-1])])] = _LITERAL
        title = (k == _LITERAL) & self.title[i]
        k[title] = np.where(first[title], _OPENING, _NAME)
        return self.hash[i], k, of


def _folded(words: np.ndarray, kinds: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The template with words that are ``more`` of a name folded into the word before them."""
    start = np.flatnonzero(~more)
    offset = np.arange(len(words)) - np.repeat(start, np.diff(np.append(start, len(words))))
    kind = kinds[start]
    kind[np.diff(np.append(start, len(words))) > 1] = _NAME
    return np.add.reduceat(words * np.power(_MULT, offset.astype(np.uint64)), start), kind


def _more(kinds: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words that go on with a name, with and without a sentence's opening word as its first."""
    name = kinds == _NAME
    go_on = name[1:] if of is None else name[1:] & (of[1:] == of[:-1])
    none = np.zeros(min(1, len(kinds)), bool)
    return np.concatenate([none, go_on & (name | (kinds == _OPENING))[:-1]]), np.concatenate([none, go_on & name[:-1]])


def _sequences(words: np.ndarray, kinds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The template word by word; where that differs, also with each run of
    name words as one slot, with and without the word that opens the sentence."""
    out = [(words, kinds)]
    whole, inside = _more(kinds)
    if whole.any():
        out.append(_folded(words, kinds, whole))
        if inside.any() and (inside != whole).any():
            out.append(_folded(words, kinds, inside))
    return out


def _slots(kinds: np.ndarray, folded: bool) -> list[np.ndarray]:
    """Which kinds are placeholders, for each reading that differs."""
    names, opening = (kinds == _NAME).any(), (kinds == _OPENING).any()
    out = [np.array([False, True, True, True, True])] if opening else []
    if names:
        out.append(np.array([False, True, True, True, False]))
    if not folded:
        out.append(np.array([False, True, False, True, False]))
    return out


def _windows(words: np.ndarray, kinds: np.ndarray, size: int, slots: np.ndarray) -> np.ndarray:
    """Hash of each window, with the kinds in ``slots`` as placeholders."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    slot = slots[kinds]
    codes = np.where(slot, _PLACEHOLDER[kinds], words)
    plain = np.concatenate([[0], np.cumsum(~slot)])
    few = plain[size:] - plain[:-size] < min(LITERALS, size)

    def fold(c: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = (out ^ c[j:j + n]) * _MULT
            out ^= out >> np.uint64(29)
        return out

    out = fold(codes)
    if few.any():
        out[few] = fold(words)[few]
    return out


class Items:
    """A block of benchmark items and the hash table of their windows."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float):
        reader = Reader()
        self.similarity = similarity
        self.ids = [i for i, _ in rows]
        self.templates = [_sequences(*reader.template(t)) for _, t in rows]
        self.sizes = [[min(WINDOW, len(w)) for w, _ in t] for t in self.templates]
        # size -> hash -> (item, sequence, position)
        self.at: dict[int, dict[int, dict[tuple[int, int, int], None]]] = defaultdict(lambda: defaultdict(dict))
        for n, t in enumerate(self.templates):
            for q, (w, k) in enumerate(t):
                if len(w):
                    size = self.sizes[n][q]
                    for slots in _slots(k, q > 0):
                        for pos, h in enumerate(_windows(w, k, size, slots).tolist()):
                            self.at[size][h][n, q, pos] = None
        self.filters = {}
        for size, at in self.at.items():
            bits = min(_FILTER_BITS, (64 * len(at)).bit_length())
            f = np.zeros(1 << bits, bool)
            f[np.fromiter(at, np.uint64, len(at)) >> np.uint64(64 - bits)] = True
            self.filters[size] = bits, f

    def _consistent(self, item: int, q: int, shift: int, hits: list[int], words: np.ndarray, kinds: np.ndarray) -> list[int]:
        """Hits whose slots map one to one, in the order of the item."""
        iw, ik = self.templates[item][q]
        there: dict[int, int] = {}
        back: dict[int, int] = {}
        out = []
        for p in hits:
            new = []
            for i in range(p, p + self.sizes[item][q]):
                kind, other = ik[i], kinds[i + shift]
                if kind != _LITERAL or other != _LITERAL:
                    a, b = int(iw[i]), int(words[i + shift])
                    if a == b and _OPENING in (kind, other):  # the same plain word
                        continue
                    if there.get(a, b) != b or back.get(b, a) != a:
                        break
                    new.append((a, b))
            else:
                there.update(new)
                back.update((b, a) for a, b in new)
                out.append(p)
        return out

    def search(self, words: np.ndarray, kinds: np.ndarray) -> list[tuple[int, int, float]]:
        """(item id, windows hit, best share within a stretch) of the items found."""
        near: dict[tuple[int, int, int, int], set[int]] = defaultdict(set)
        sequences = _sequences(words, kinds)
        for d, (w, k) in enumerate(sequences):
            for size, (bits, f) in self.filters.items():
                at = self.at[size]
                for slots in _slots(k, d > 0):
                    h = _windows(w, k, size, slots)
                    for p in np.flatnonzero(f[h >> np.uint64(64 - bits)]).tolist():
                        for item, q, pos in at.get(int(h[p]), ()):
                            near[item, q, d, p - pos].add(pos)
        found: dict[int, tuple[int, float]] = {}
        for (item, q, d, shift), pos in near.items():
            total = len(self.templates[item][q][0]) - self.sizes[item][q] + 1
            span = min(STRETCH - WINDOW + 1, total)
            if len(pos) < self.similarity * span:
                continue
            ok = np.zeros(total, np.int64)
            ok[self._consistent(item, q, shift, sorted(pos), *sequences[d])] = 1
            sums = np.concatenate([[0], np.cumsum(ok)])
            share = float((sums[span:] - sums[:-span]).max()) / span
            if share >= self.similarity and (int(ok.sum()), share) > found.get(item, (0, 0.0)):
                found[item] = int(ok.sum()), share
        return [(self.ids[i], n, s) for i, (n, s) in sorted(found.items())]


_reader = Reader()
_ITEM_WINDOWS = "no long, q int, pos int, size int, h long, need int"


def _item_windows(similarity: float):
    """Items -> one row per window and reading; ``need``: windows that one alignment must have."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for no, text in zip(pdf["no"], pdf["text"], strict=True):
                for q, (w, k) in enumerate(_sequences(*_reader.template(text))):
                    size = min(WINDOW, len(w))
                    if not size:
                        continue
                    need = math.ceil(similarity * min(STRETCH - WINDOW + 1, len(w) - size + 1) - 1e-9)
                    rows = {(pos, h) for slots in _slots(k, q > 0) for pos, h in enumerate(_windows(w, k, size, slots).view(np.int64).tolist())}
                    out += [(no, q, pos, size, h, need) for pos, h in rows]
            yield pd.DataFrame(out, columns=["no", "q", "pos", "size", "h", "need"])

    return run


def _hits(bits, sizes: list[int]):
    """Texts -> their windows that may be an item's: ``(k1, k2, d, p, size, h)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool)
        for pdf in batches:
            words, kinds, of = _reader.templates(pdf["text"].tolist())
            place = np.arange(len(words)) - np.searchsorted(of, of)
            found = []
            for d, more in enumerate((None, *_more(kinds, of))):
                if more is None:
                    w, k, o, p = words, kinds, of, place
                    differs = np.ones(len(pdf), bool)
                elif more.any():
                    w, k = _folded(words, kinds, more)
                    o = of[~more]
                    p = np.arange(len(w)) - np.searchsorted(o, o)
                    differs = np.zeros(len(pdf), bool)
                    differs[of[more]] = True
                else:
                    continue
                for size in sizes:
                    last = np.arange(size - 1, len(w))
                    inside = (o[last] == o[:len(last)]) & differs[o[last]]
                    for slots in _slots(k, d > 0):
                        h = _windows(w, k, size, slots)
                        at = np.flatnonzero(known[h >> np.uint64(64 - FILTER_BITS)] & inside)
                        found.append((o[at], np.full(len(at), d), p[at], np.full(len(at), size), h[at].view(np.int64)))
            if found:
                o, d, p, size, h = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"k1": pdf["k1"].to_numpy()[o], "k2": pdf["k2"].to_numpy()[o], "d": d, "p": p, "size": size, "h": h}).drop_duplicates()

    return run


def _check(similarity: float):
    """Pairs of text and item, sorted by text -> those that hold: ``(k1, k2, no, item, windows, share)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict[int, Items] = {}
        last, template = None, None
        for pdf in batches:
            out = []
            for k1, k2, text, no, item, item_text in zip(*(pdf[c] for c in ("k1", "k2", "text", "no", "item", "item_text")), strict=True):
                if (k1, k2) != last:
                    last, template = (k1, k2), _reader.template(text)
                if no not in items:
                    if len(items) > 2000:
                        items.clear()
                    items[no] = Items([(item, item_text)], similarity)
                out += [(k1, k2, no, item, n, share) for _, n, share in items[no].search(*template)]
            yield pd.DataFrame(out, columns=["k1", "k2", "no", "item_id", "windows", "share"])

    return run


def find_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
               similarity: float = SIMILARITY, out: str = "leaks") -> DataFrame:
    """``df`` plus an array of ``(item_id, windows, share)`` of the items found in the text."""
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "decontam")
    k1, k2 = F.xxhash64(F.col(text_col)), F.xxhash64(F.lit("second"), F.col(text_col))
    items = scratch.cut(benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
                        .select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text"))
                        .withColumn("no", F.monotonically_increasing_id()))
    windows = scratch.cut(items.select("no", "text").mapInPandas(_item_windows(similarity), _ITEM_WINDOWS))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW numbers
    prefixes = windows.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()
    known = np.zeros(1 << FILTER_BITS, bool)
    known[prefixes] = True
    bits = spark.sparkContext.broadcast(np.packbits(known).tobytes())
    texts = df.select(F.col(text_col).alias("text")).where("text <> ''").select(
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), F.col("text")).alias("k2"), "text")
    hits = scratch.cut(texts.mapInPandas(_hits(bits, sizes), "k1 long, k2 long, d int, p int, size int, h long"))
    aligned = hits.join(windows, ["size", "h"]).groupBy("k1", "k2", "d", "no", "q", (F.col("p") - F.col("pos")).alias("shift")) \
        .agg(F.size(F.collect_set("pos")).alias("n"), F.first("need").alias("need")).where("n >= need")
    pairs = scratch.cut(aligned.select("k1", "k2", "no").distinct())
    asked = texts.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    both = pairs.join(asked, ["k1", "k2"]).join(items.select("no", "item", F.col("text").alias("item_text")), "no")
    ordered = both.repartition("k1", "k2", "no").sortWithinPartitions("k1", "k2", "no").select("k1", "k2", "text", "no", "item", "item_text")
    held = ordered.mapInPandas(_check(similarity), "k1 long, k2 long, no long, item_id long, windows int, share double")
    names = fresh(df, "_k1", "_k2", "_leaks_found")
    per_text = scratch.cut(held.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("item_id", "no", "windows", "share"))).alias("f"))
                           .select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]), F.transform("f", lambda x: F.struct(
                               x["item_id"].alias("item_id"), x["windows"].alias("windows"), x["share"].alias("share"))).alias(names[2])))
    keep = [c for c in df.columns if c != out]
    joined = df.join(per_text, (k1 == F.col(names[0])) & (k2 == F.col(names[1])), "left")
    none = F.array().cast("array<struct<item_id: bigint, windows: int, share: double>>")
    return joined.select(*[df[c] for c in keep], F.coalesce(F.col(names[2]), none).alias(out))
