"""Span extraction, overlap resolution and allow-listing as column expressions.

A document's detections live *in its row* as ``array<struct>``: extraction,
sorting, the overlap fold and the allow filter are narrow projections (no
shuffle), so they run unchanged on batch tables and on streams.

Offsets.  Spark's regex functions return matched strings but not positions.
``regexp_replace(text, (pre)(val)(post), '$1\\x01$2\\x01$3')`` brackets every
value with two sentinels; ``split`` on that one character (no regex) yields
``[gap0, val0, gap1, val1, ...]`` whose element lengths add up to the original
offsets.  Prefix sums are computed with a log-depth (Hillis-Steele) scan over
the length array, so a row with k matches costs O(k log k), not O(k^2).
Sentinels cannot occur after control-character stripping; on raw text they
are first swapped for another control character of equal length (both are
non-space, non-word characters, so no pattern's matches change), and span
text is always cut from the unmodified input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..catalog import SpanPattern
from . import dialect, gates, marks
from .lets import before, let, running_max

SENTINEL = "\u0001"
_SENT_SWAP = "\u0003"

# Up to here the fold over all spans costs less than looking for their islands.
FEW_SPANS = 48

# Internal span layout: the sort key comes first so the natural struct order
# of ``sort_array`` is the merge order (start asc, score desc, source asc,
# catalogue order asc); remaining fields make ties deterministic.
SPAN_TYPE = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("nscore", T.DoubleType()),
    T.StructField("source", T.IntegerType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

# Public span layout (detect output).
PUBLIC_SPAN_TYPE = T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

def empty_spans() -> Column:
    return F.array().cast(T.ArrayType(SPAN_TYPE))


def make_span(entity_type: Column | str, start: Column, end: Column, score: Column | float,
              text: Column, source: int | Column, ord_: int | Column) -> Column:
    et = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    sc = F.lit(float(score)) if isinstance(score, (int, float)) else score
    return F.struct(
        start.cast("int").alias("start"),
        (-sc).cast("double").alias("nscore"),
        (F.lit(source) if isinstance(source, int) else source).cast("int").alias("source"),
        (F.lit(ord_) if isinstance(ord_, int) else ord_).cast("int").alias("ord"),
        end.cast("int").alias("end"),
        et.alias("entity_type"),
        sc.cast("double").alias("score"),
        text.alias("text"),
    )


def safe_text(text: Column) -> Column:
    """Text with sentinel characters swapped out (same length, same matches)."""
    return F.translate(text, SENTINEL, _SENT_SWAP)


def marked_lengths(text: Column, java_three_group: str, size=F.length) -> Column:
    """Lengths of ``[gap0, val0, gap1, val1, ..., gapN]`` for one pattern."""
    parts = F.split(F.regexp_replace(text, java_three_group, f"$1{SENTINEL}$2{SENTINEL}$3"), SENTINEL, -1)
    return F.transform(parts, lambda p: size(p))


def spans_from_lengths(lens: Sequence[str], original: str, patterns: Sequence[SpanPattern], source: int, ord_offset: int) -> Column:
    """Spans of all patterns from the columns named ``lens``, one for each, and
    ``original``.  A single part means no match: only patterns with more are
    looked at any further, however many there are.

    Written as SQL text: one expression, built in one call."""
    t = f"`{original}`"
    rows = ", ".join(f"named_struct('n', `{n}`, 'ord', {ord_offset + i}, 'et', {dialect.sql_literal(p.entity_type)}, 'sc', {float(p.score)!r}D)"
                     for i, (n, p) in enumerate(zip(lens, patterns)))

    def span(start: str, size: str) -> str:
        return (f"named_struct('start', {start}, 'nscore', -h.sc, 'source', {source}, 'ord', h.ord, "
                f"'end', {start} + {size}, 'entity_type', h.et, 'score', h.sc, 'text', substring({t}, {start} + 1, {size}))")

    strides = "transform(sequence(0, length(bin(size(h.n) - 1)) - 1), k -> shiftleft(1, k))"
    ends = f"aggregate({strides}, h.n, (acc, d) -> transform(acc, (x, i) -> x + coalesce(get(acc, i - d), 0)))"
    many = (f"zip_with(filter(zip_with({ends}, h.n, (e, l) -> e - l), (x, i) -> i % 2 = 1), "
            f"filter(h.n, (x, i) -> i % 2 = 1), (s, l) -> {span('s', 'l')})")
    # one match (3 parts) is the common case: offsets need no scan
    one = f"array({span('get(h.n, 0)', 'get(h.n, 1)')})"
    return F.expr(f"flatten(transform(filter(array({rows}), h -> size(h.n) > 1), h -> CASE WHEN size(h.n) = 3 THEN {one} ELSE {many} END))")


def arrow_spans(text: Column, patterns: Sequence[SpanPattern], source: int = 0, ord_offset: int = 0) -> Column:
    """Spans of the patterns that Arrow can search for, null where ``text`` is null."""
    mine = marks.readable(patterns)
    if not mine:
        return F.when(text.isNotNull(), empty_spans())
    return marks.spans_of([patterns[i] for i in mine], [ord_offset + i for i in mine], source, SPAN_TYPE)(text)


def with_pattern_spans(df: DataFrame, text_col: str, patterns: Sequence[SpanPattern], out_col: str,
                       source: int = 0, ord_offset: int = 0, raw: bool = False, gated: bool = True,
                       wanted=None, given: str | None = None) -> DataFrame:
    """Add ``out_col`` = spans of every pattern, concatenated in catalogue order.

    Projections: (0) per-row gate inputs (lower-cased text, digit and
    special-fold flags, the length and whether all is ASCII), (1) each regex once,
    skipped where its gate is false, keeping only int length arrays, (2) lengths
    -> spans.  Keeping the stages apart stops the optimizer from inlining a regex
    into a lambda body.  Plain ASCII rows get the spans of all patterns that RE2
    reads alike from Arrow (``functions.marks``); the others are Java's.  There too
    ASCII rows run a regex without its Unicode flag, and their parts' bytes are
    their lengths.
    ``raw``: text may contain the sentinel characters (detect path on
    unsanitised input).  ``wanted(entity_type) -> Column``: optional per-row
    condition; where false the pattern is not run (its spans would be
    discarded anyway, e.g. by the context filter).  ``given``: a column that holds
    ``arrow_spans`` of the same patterns already, null for rows that are not plain.
    """
    text = F.col(text_col)
    by_arrow = marks.readable(patterns)
    found, is_plain = f"__found_{out_col}", f"__plain_{out_col}"
    # each row's spans are made by one side: Java's columns cost nothing where the row is Arrow's
    df = df.withColumn(is_plain, F.col(given).isNotNull() if given else marks.plain(text) if by_arrow else F.lit(False))
    df = df.withColumnRenamed(given, found) if given else df.withColumn(
        found, arrow_spans(F.when(F.col(is_plain), text), patterns, source, ord_offset))
    tmp = [f"__lens_{out_col}_{i}" for i in range(len(patterns))]
    gcols = [f"__g_{out_col}_{k}" for k in ("low", "special", "digit")]
    size_col, ascii_col = f"__g_{out_col}_size", f"__g_{out_col}_ascii"
    pre = [F.length(text).alias(size_col), (F.octet_length(text) == F.length(text)).alias(ascii_col)]
    java_text = text if len(by_arrow) < len(patterns) else F.when(~F.col(is_plain), text)
    if gated:
        low, special, digit = gates.gate_inputs(java_text)
        pre += [low.alias(gcols[0]), special.alias(gcols[1]), digit.alias(gcols[2])]
    scan_col = f"__scan_{out_col}"
    if raw:  # computed once, read by every pattern
        pre.append(safe_text(java_text).alias(scan_col))
        gcols = gcols + [scan_col]
    gcols = [*gcols, size_col, ascii_col]
    df = df.select("*", *pre)
    scan = F.col(scan_col) if raw else text
    lens = []
    for i, (p, t) in enumerate(zip(patterns, tmp)):
        la = gates.lookahead(p) if gated else None
        java = dialect.three_group_java(p.regex, p.group, la)
        expr, ascii_only = marked_lengths(scan, java), dialect.ascii_java(java, p.regex)
        if ascii_only:
            expr = F.when(F.col(ascii_col), marked_lengths(scan, ascii_only, F.octet_length)).otherwise(expr)
        g = gates.gate(p, text, *[F.col(c) for c in gcols[:3]]) if gated else None
        if wanted is not None:
            w = wanted(p.entity_type)
            g = w if g is None else (w & g)
        if i in by_arrow:
            g = ~F.col(is_plain) if g is None else (~F.col(is_plain) & g)
        if g is not None:
            expr = F.when(g, expr).otherwise(F.array(F.col(size_col)))
        lens.append(expr.alias(t))
    staged = df.select(*[c for c in df.columns if c not in gcols], *lens)
    out = spans_from_lengths(tmp, text_col, patterns, source, ord_offset) if tmp else empty_spans()
    if by_arrow:
        mine = F.col(found)
        if wanted is not None:
            mine = F.filter(mine, lambda s: reduce(lambda a, b: a | b, [(s["entity_type"] == et) & wanted(et) for et in dict.fromkeys(p.entity_type for p in patterns)]))
        out = F.when(~F.col(is_plain), out).otherwise(mine if len(by_arrow) == len(patterns) else F.concat(mine, out))
    return staged.select(*[c for c in staged.columns if c not in (*tmp, found, is_plain)], out.alias(out_col))


def with_layer1_spans(df: DataFrame, text_col: str = "text", out_col: str = "regex_spans",
                      patterns: Sequence[SpanPattern] = catalog.LAYER1_PATTERNS, raw: bool = False, given: str | None = None) -> DataFrame:
    """Layer 1 (R0): every pattern, every context, in catalogue order."""
    return with_pattern_spans(df, text_col, patterns, out_col, source=0, raw=raw, given=given)


# ----------------------------------------------------------------- merge (M1-M3)
def sort_spans(spans: Column) -> Column:
    # array_sort compares by an interpreted lambda; its order differs for null elements only
    return F.sort_array(spans)


def islands(sorted_spans: Column) -> Column:
    """Spans sorted by start -> array of arrays: a new island begins where a
    span starts at or after the end of all before it."""
    def cut(sp):
        ends = before(running_max(F.transform(sp, lambda s: s["end"])), F.lit(0))
        heads = F.array_compact(F.zip_with(F.transform(sp, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"))),
                                           ends, lambda s, e: F.when((s["i"] == 0) | (s["start"] >= e), s["i"])))
        return let(heads, lambda h: F.zip_with(
            h, F.concat(F.slice(h, F.lit(2), F.size(h)), F.array(F.size(sp))),
            lambda x, y: F.slice(sp, x + 1, y - x)))

    return let(sorted_spans, lambda sp: F.when(F.size(sp) > 0, cut(sp)).otherwise(F.array().cast(T.ArrayType(T.ArrayType(SPAN_TYPE)))))


def merge_fold(sorted_spans: Column) -> Column:
    """Greedy left fold against the last *kept* span.

    Overlap iff ``x.start < last.end``; an overlapping span replaces the last
    kept one iff its score is strictly greater, or equal with a strictly
    longer span; otherwise it is dropped.  Exact fold semantics: a span
    dropped in favour of a later winner is never reconsidered.  Spans of
    different islands never meet, so the fold runs island by island and its
    cost follows the largest island, not the document.
    """
    # the state is the last kept span, which may still be replaced, and those before it, which may not
    def step(acc, x):
        last = acc["last"]
        overlaps = x["start"] < last["end"]
        better = (x["score"] > last["score"]) | (
            (x["score"] == last["score"]) & ((x["end"] - x["start"]) > (last["end"] - last["start"])))
        return F.struct(F.when(overlaps & ~better, last).otherwise(x).alias("last"),
                        F.when(overlaps, acc["done"]).otherwise(F.concat(acc["done"], F.array(last))).alias("done"))

    def fold(part):
        return F.aggregate(F.slice(part, F.lit(2), F.size(part)), F.struct(F.get(part, 0).alias("last"), empty_spans().alias("done")),
                           step, lambda acc: F.concat(acc["done"], F.array(acc["last"])))

    def by_island(sp):
        return F.flatten(F.transform(islands(sp), lambda part: F.when(F.size(part) == 1, part).otherwise(fold(part))))

    # few spans are folded at once: finding their islands takes longer
    return let(sorted_spans, lambda sp: F.when(F.size(sp).between(1, FEW_SPANS), fold(sp)).otherwise(by_island(sp)))


def merge_best(sorted_spans: Column) -> Column:
    """The best set of spans of which no two overlap: the largest sum of scores,
    then most characters, then as early as possible.

    Unlike the fold it never loses a span that nothing kept overlaps.  Dynamic
    programming over each island's spans by their ends: the best set up to a
    span is the best one without it, or it with the best set that ends before
    it starts.  Quadratic in an island."""
    state = "array<struct<end:int,score:double,chars:int,kept:array<int>>>"
    start = F.array(F.struct(F.lit(-1).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("kept"))).cast(state)

    def step(acc, x, i):
        before_ = F.element_at(F.filter(acc, lambda e: e["end"] <= x["start"]), -1)
        without = F.element_at(acc, -1)
        score = F.round(before_["score"] + x["score"], 9)
        chars = before_["chars"] + x["end"] - x["start"]
        better = (score > without["score"]) | ((score == without["score"]) & (chars > without["chars"]))
        return F.concat(acc, F.array(F.when(better, F.struct(
            x["end"].alias("end"), score.alias("score"), chars.alias("chars"), F.concat(before_["kept"], F.array(i)).alias("kept"))).otherwise(
            F.struct(x["end"].alias("end"), without["score"].alias("score"), without["chars"].alias("chars"), without["kept"].alias("kept")))))

    def best(part):
        by_end = F.sort_array(F.transform(part, lambda s, i: F.struct(s["end"].alias("end"), i.alias("i"), s.alias("s"))))
        numbered = F.transform(by_end, lambda e, i: F.struct(e["s"].alias("s"), i.alias("i")))
        return let(numbered, lambda n: F.sort_array(F.transform(
            F.element_at(F.aggregate(n, start, lambda acc, e: step(acc, e["s"], e["i"])), -1)["kept"], lambda k: F.get(n, k)["s"])))

    return F.flatten(F.transform(islands(sorted_spans), lambda part: F.when(F.size(part) == 1, part).otherwise(best(part))))


# ------------------------------------------------------------ allow-list
def combined_fullmatch(patterns: Sequence[str]) -> str:
    r"""One anchored alternation equivalent to "any pattern fully matches":
    when ``\z`` fails after one alternative the engine backtracks into the
    next, so ``\A(?:a|b)\z`` matches iff ``a`` or ``b`` matches the whole
    text.  Leading inline flags stay scoped to their own alternative."""
    alts = []
    for p in patterns:
        flags, body = dialect.split_flags(p)
        alts.append(f"(?{flags}:{body})" if flags else f"(?:{body})")
    return f"(?Ud)\\A(?:{'|'.join(alts)})\\z"


def allow_match(text: Column, allow_patterns: Sequence[str] = catalog.ALLOW_PATTERNS) -> Column:
    """True iff ``text`` fully matches any allow pattern."""
    if not allow_patterns:
        return F.lit(False)
    return text.rlike(combined_fullmatch(allow_patterns))


def allow_filter(spans: Column, allow_patterns: Sequence[str] = catalog.ALLOW_PATTERNS) -> Column:
    return F.filter(spans, lambda s: ~allow_match(s["text"], allow_patterns))


def to_public(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"),
        s["score"].alias("score"), s["text"].alias("text")))
