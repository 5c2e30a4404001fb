"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read as a sequence of text blocks and tags.  Words score what the
markup around them is worth (tag names, class and id words of all open
elements, share of linked words), tags cost a little each; one linear scan
finds the contiguous region of the largest sum.  Blocks of the region come out
in page order, without those that their own markup names as something else
(menus, adverts, forms, comments, ...), which take no part in the sums: a tag
like ``nav``, or a class or role all of whose words are such names or words of
layout (``ad-slot``, ``site-footer``; not ``share-price``).  An ``id`` says
less: it only scores.  Headings are not judged by names at all.  Only
parts of a page are judged by their names: ``html`` and ``body``, elements
around most of the main text and those around most of the page say nothing
about what they hold, whatever they are called.

What the names around a block say is kept per element, as what its parent's
says and its own names, so a block costs what changed since the one before,
however deep the page is.

Weights are log-odds learnt from labelled pages: a bounded sample of pages that
mark their main text themselves (``article``, ``main``, ``articleBody``); what
these elements hold is inside, the rest outside.  The fixed word lists below
act as a prior where the sample has not seen a word.

Defined results: null and empty pages, and pages whose best sum is not
positive, give an empty text.  Of equal sums the first region counts.
Unclosed elements end with their parent, ``head`` with the first thing that cannot be
in it; an unfinished tag or comment at the
end of a page is markup.  Repeated rows are worked on each; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea select datalist".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
NOT_MAIN = frozenset("nav footer aside form button menu dialog".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
# What closes an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}}
# Class and id words of other parts of a page, and of the main part.
OTHER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay "
                        "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead topbar header footer "
                        "sidebar side aside rail widget widgets related recommended recommendations trending popular "
                        "notice notices cookie cookies consent gdpr alert disclaimer copyright legal "
                        "comment comments commentlist reply replies respond discussion disqus "
                        "share sharing social follow newsletter subscribe subscription signup login search form hidden".split())
MAIN_WORDS = frozenset("article content main post entry story body text articlebody".split())
# Words of layout, which beside one of the other parts' words change nothing.
LAYOUT_WORDS = frozenset("area bar bars block blocks bottom box boxes btn button buttons center col column container content contents global group "
                         "header heading holder icon icons inner item items js left link links list lists main module outer page pages panel "
                         "post posts article articles primary region right row secondary section site slot tab tabs text title top unit "
                         "web wrap wrapper zone desktop mobile sticky fixed large small".split())
_PRIOR = 2.0
_TAG_COST = 0.05
_CAP = 3.0
_WRAP = 0.8

# A quote opens a value only after "=".
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))|[^\s/>=]+""")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_NONE: frozenset[str] = frozenset()


def _labels(name: str, attrs: str) -> tuple[frozenset[str], frozenset[str]]:
    """Lower-case words of an element's class, id, role and itemprop, and those of
    class, role and itemprop that say that it is no main text."""
    if "=" not in attrs:
        return _NONE, _NONE
    out, other = set(), set()
    for m in _ATTRIBUTE.finditer(attrs):
        key = m[1] and m[1].lower()
        if key not in ("class", "id", "role", "itemprop"):
            continue
        for token in html.unescape(m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in _WORDS.findall(token)} | {token.lower()}
            named = words & OTHER_WORDS
            parts = words - {token.lower()} or words
            if named and (name in HEADINGS or not parts <= OTHER_WORDS | LAYOUT_WORDS):
                words -= OTHER_WORDS  # the name of something else that has such a word in it
            elif key != "id":
                other |= named
            out |= words
    return frozenset(out), _NONE if out & MAIN_WORDS else frozenset(other)


class Block:
    __slots__ = ("tags", "text", "at", "words", "linked")

    def __init__(self, text: str, at: int, words: int, linked: int, tags: int):
        self.text, self.at, self.words, self.linked, self.tags = text, at, words, linked, tags


class Page:
    """A page's text blocks in order, each with the number of its innermost element
    (-1: none) and of the tags before it, and the elements with their parents."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.name: list[str] = []
        self.labels: list[frozenset[str]] = []
        self.other: list[frozenset[str]] = []
        self.parent: list[int] = []
        self.main: list[int] = []  # the innermost main element, itself included
        self._read(page)
        self._judge()

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # name and the innermost element that is not inline
        opened: Counter = Counter()
        text: list[str] = []
        linked: list[str] = []
        hidden = tags = 0
        where = -1

        def cut(i: int) -> None:
            nonlocal hidden
            for n, _ in stack[i:]:
                opened[n] -= 1
                hidden -= n in HIDDEN
            del stack[i:]

        def end_block() -> None:
            nonlocal tags
            joined = " ".join("".join(text).split())
            if joined:
                self.blocks.append(Block(joined, where, len(joined.split()), len("".join(linked).split()), tags))
                tags = 0
            text.clear()
            linked.clear()

        def add(raw: str) -> None:
            nonlocal where
            if raw and stack and stack[-1][0] == "head" and not raw.isspace():
                cut(len(stack) - 1)
            if raw and not hidden:
                piece = html.unescape(raw)
                if not text:
                    where = stack[-1][1] if stack else -1
                text.append(piece)
                if opened["a"]:
                    linked.append(piece + " ")

        at = 0
        while m := _MARKUP.search(page, at):
            add(page[at:m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            tags += 1
            if name not in INLINE:
                end_block()
            if m[1]:
                if opened[name]:
                    cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
                continue
            if stack and stack[-1][0] == "head" and name not in IN_HEAD:
                cut(len(stack) - 1)
            if name == "br" or name in VOID:
                continue
            closes = SIBLINGS.get(name, set()) if name in SIBLINGS else {"p"} if name not in INLINE else set()
            if any(opened[c] for c in closes):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        cut(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
            if m[3].endswith("/") and name in {"svg", "math"}:
                continue
            up = stack[-1][1] if stack else -1
            if name not in INLINE:
                self.name.append(name)
                labels, other = _labels(name, m[3])
                self.labels.append(labels)
                self.other.append(other)
                self.parent.append(up)
                mine = name in MAIN or "articlebody" in labels or "main" in labels
                self.main.append(len(self.main) if mine else self.main[up] if up >= 0 else -1)
                up = len(self.name) - 1
            stack.append((name, up))
            opened[name] += 1
            hidden += name in HIDDEN
            if name in RAW:  # no markup inside
                end = re.compile(rf"</{name}\b", re.I).search(page, at)
                at = end.start() if end else len(page)
        add(page[at:])
        end_block()

    def _judge(self) -> None:
        """For each element, what its names and those around it say of a block in it.

        Elements that are too large a part of the page are not judged by their names: of a main element and what is
        around it, those with more than half of all words in main elements; below the innermost main element, those with
        more than ``_WRAP`` of its words (comments may be longer than what they comment on); on other paths, those with
        more than half of the page's words."""
        n = len(self.name)
        words, main_words = [0] * n, [0] * n
        total = total_main = 0
        for b in self.blocks:
            total += b.words
            if b.at >= 0:
                words[b.at] += b.words
                if self.main[b.at] >= 0:
                    main_words[b.at] += b.words
                    total_main += b.words
        for e in range(n - 1, -1, -1):
            if self.parent[e] >= 0:
                words[self.parent[e]] += words[e]
                main_words[self.parent[e]] += main_words[e]
        around: list[tuple] = []  # of an element that holds the block's main element, or is it
        self.says: list[tuple[frozenset[str], frozenset[str]]] = []  # (features of other parts, features)
        self.tail: list[frozenset[str]] = []
        for e in range(n):
            up, main = self.parent[e], self.main[e]
            page_wide = self.name[e] in ("html", "body")
            above = around[up] if up >= 0 else (_NONE, _NONE)
            around.append(self._with(above, e, page_wide or 2 * main_words[e] > total_main))
            if main == e:
                whole = page_wide or 2 * main_words[e] > total_main
                self.says.append(around[e])
            else:
                whole = page_wide or (words[e] > _WRAP * words[main] if main >= 0 else 2 * words[e] > total)
                self.says.append(self._with(self.says[up] if up >= 0 else (_NONE, _NONE), e, whole))
            self.tail.append(frozenset() if whole and self.name[e] in NOT_MAIN else frozenset([f"in {self.name[e]}"]))

    def _with(self, above: tuple[frozenset[str], frozenset[str]], e: int, whole: bool) -> tuple[frozenset[str], frozenset[str]]:
        name, labels = self.name[e], self.labels[e]
        other, features = set(), {f".{w}" for w in (labels - OTHER_WORDS if whole else labels)}
        if name not in ("html", "body") and not (whole and name in NOT_MAIN):
            features.add(f"<{name}>")
        if not whole:
            if name in NOT_MAIN or (name == "header" and self.main[e] < 0):
                other.add(f"<{name}>")
            other |= {f".{w}" for w in self.other[e]}
        return tuple(a if b <= a else a | b for a, b in zip(above, (other, features), strict=True))

    def others(self, b: Block) -> frozenset[str]:
        """The features by which the markup itself says that a block is no main text."""
        return self.says[b.at][0] if b.at >= 0 else _NONE

    def features(self, b: Block) -> frozenset[str]:
        return (self.says[b.at][1] | self.tail[b.at] if b.at >= 0 else _NONE) | {_linked(b)}

    def in_main(self, b: Block) -> bool:
        return b.at >= 0 and self.main[b.at] >= 0


def _linked(b: Block) -> str:
    return f"linked {4 * b.linked // max(b.words, 1)}"


def _prior(f: str) -> float:
    w = f.strip("<>.")
    if f.startswith("<"):
        return _PRIOR if w in MAIN else -_PRIOR if w in NOT_MAIN else 0.0
    return (_PRIOR if w in MAIN_WORDS else -_PRIOR if w in OTHER_WORDS else 0.0) if f.startswith(".") else 0.0


#: Weights without any labelled page.
DEFAULT = {"in p": 1.0, "linked 0": 0.5, "linked 1": 0.25, "linked 3": -1.5, "linked 4": -2.0}


def page_counts(page: str) -> tuple[Counter, Counter] | None:
    """Words per feature inside and outside of the main element; None for pages without exactly that markup."""
    found = Page(page)
    inside, outside = Counter(), Counter()
    for b in found.blocks:
        other = found.others(b)
        main = found.in_main(b) and not other
        side = inside if main else outside
        # What a menu's own markup explains says nothing about lists as such.
        for f in other | {_linked(b)} if other else found.features(b):
            side[f] += 1
        side[""] += 1
    return (inside, outside) if inside[""] and outside[""] else None


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log-odds of each feature, from the number of blocks that have it."""
    if not inside[""] or not outside[""]:
        return dict(DEFAULT)
    out = {}
    for f in set(inside) | set(outside):
        if f:
            odds = math.log((inside[f] + 0.5) / (inside[""] + 1)) - math.log((outside[f] + 0.5) / (outside[""] + 1))
            out[f] = max(-_CAP, min(_CAP, odds))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the first contiguous part of the largest positive sum."""
    best, start, end = 0.0, 0, 0
    run, run_start = 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, run_start = 0.0, i
        run += s
        if run > best:
            best, start, end = run, run_start, i + 1
    return start, end


def main_text(page: str | None, learnt: dict[str, float]) -> str:
    if not page:
        return ""
    found = Page(page)
    # Where the page says what may be main text, the scan still chooses within the sequence.
    absent = -_CAP if any(map(found.in_main, found.blocks)) else 0.0
    kept, scores = [], []
    tags = 0
    for b in found.blocks:
        tags += b.tags
        if found.others(b):
            tags = 0
            continue
        w = sum(learnt.get(f, _prior(f)) for f in found.features(b))
        if not found.in_main(b):
            w += absent
        w = max(-_CAP, min(_CAP, w))
        kept.append(b)
        scores.append(b.words * w - _TAG_COST * tags)
        tags = 0
    a, z = best_region(scores)
    return " ".join(b.text for b in kept[a:z])


def learn_weights(df: DataFrame, html_col: str = "html", key_col: str = "page_id", pages: int = 2000) -> dict[str, float]:
    """Weights from about ``pages`` rows, chosen by a hash of ``key_col`` (all where there are fewer)."""
    n = df.count()
    if not n:
        return dict(DEFAULT)
    share = min(1.0, pages / n)
    rows = df.where(F.pmod(F.xxhash64(F.col(key_col).cast("string")), F.lit(1 << 20)) < F.lit(share * (1 << 20))) \
        .select(F.col(html_col).alias("html"))

    def count(batches):
        for pdf in batches:
            total = {}
            for p in pdf["html"]:
                got = page_counts(p) if p else None
                for side, c in zip(("i", "o"), got or (), strict=False):
                    for f, k in c.items():
                        total[side, f] = total.get((side, f), 0) + k
            yield pd.DataFrame([(s, f, k) for (s, f), k in total.items()], columns=["side", "feature", "n"])

    small_batches(df.sparkSession)
    # Feature names come from at most ``pages`` pages.
    got = rows.mapInPandas(count, "side string, feature string, n long").groupBy("side", "feature").agg(F.sum("n").alias("n")).collect()
    sides = {"i": Counter(), "o": Counter()}
    for r in got:
        sides[r["side"]][r["feature"]] = r["n"]
    return weights(sides["i"], sides["o"])


def extract(df: DataFrame, learnt: dict[str, float], html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` plus the main text of each page."""
    sent = df.sparkSession.sparkContext.broadcast(learnt)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(p, sent.value) for p in s], dtype=object)

    small_batches(df.sparkSession)
    tmp, = fresh(df, "_text")
    keep = [c for c in df.columns if c != out]
    return df.withColumn(tmp, text(F.col(html_col))).select(*keep, F.col(tmp).alias(out))
