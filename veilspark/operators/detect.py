"""Detection: Layer 1 regex spans, recogniser-side spans, merge, allow-list.

Recogniser-side spans ("source 1") come from the financial recognisers
(Layer 3), the gazetteer, or an external span table produced by any model
job.  They are filtered by the row's context and by the literal allow terms
*before* the merge; the allow patterns apply to merged winners.  All of it is
in-row: no shuffle unless an external span table has to be joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..catalog import SpanPattern
from ..functions import dialect, marks
from ..functions import spans as S
from ..functions.lets import let
from .normalize import composed

# Ord offsets keep catalogue order within each source.
_L3_ORD = 0
_GAZ_ORD = 100
_EXT_ORD = 1000

# Recogniser regexes run with the recogniser library's default flags
# (dot-all, multi-line, case-insensitive).
RECOGNISER_FLAGS = "ism"
CUSIP_CONTEXT_BOOST = 0.35
CUSIP_CONTEXT_MIN_SCORE = 0.4
CONTEXT_PREFIX_WORDS = 5

# Up to here all pairs of a row's recogniser spans cost less than their islands.
FEW_SPANS = 12

EXTERNAL_SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
]))


def context_types(context: Column, contexts: dict | None = None) -> Column:
    """Entity types requested for a context (unknown -> general)."""
    table = contexts or catalog.CONTEXT_ENTITIES
    m = F.create_map(*[x for ctx, types in table.items()
                       for x in (F.lit(ctx), F.array(*[F.lit(t) for t in types]))])
    return F.coalesce(m[context], m[F.lit(catalog.DEFAULT_CONTEXT)])


def canonical_type(t: Column) -> Column:
    """L4: recogniser type names -> canonical names."""
    m = F.create_map(*[F.lit(x) for kv in catalog.TYPE_MAP.items() for x in kv])
    return F.coalesce(m[t], t)


def _recogniser_pattern(p: SpanPattern, flags: str = RECOGNISER_FLAGS) -> SpanPattern:
    own, body = dialect.split_flags(p.regex)
    merged = "".join(dict.fromkeys(flags + own))
    return SpanPattern(p.entity_type, f"(?{merged}){body}" if merged else body, p.score, 0)


# The last words of a text are the first ones of its reverse: anchored, so only they are read.
_LAST_WORDS = f"(?U)\\A\\W*(?:\\w+\\W+){{0,{CONTEXT_PREFIX_WORDS - 1}}}\\w+"


def _context_boost(spans: Column, text: Column, boosts: dict[str, Sequence[str]], amount: float, least: float) -> Column:
    """Raise a span's score when a context word of its type is among the words
    before it (any distance back, cut on words)."""
    if not boosts:
        return spans
    ctx = F.create_map(*[x for t, words in boosts.items() for x in (F.lit(t), F.array(*[F.lit(w) for w in words]))])
    types = list(boosts)

    def boost(s):
        back = F.regexp_extract(F.reverse(F.lower(F.substring(text, F.lit(1), s["start"]))), _LAST_WORDS, 0)
        hit = s["entity_type"].isin(types) & F.arrays_overlap(F.regexp_extract_all(F.reverse(back), F.lit("(?U)\\w+"), 0), ctx[s["entity_type"]])
        new = F.least(F.lit(1.0), F.greatest(s["score"] + amount, F.lit(least)))
        sc = F.when(hit, new).otherwise(s["score"])
        return S.make_span(s["entity_type"], s["start"], s["end"], sc, s["text"], s["source"], s["ord"])

    return F.transform(spans, boost)


def _drop_contained(spans: Column) -> Column:
    """Recogniser-level de-duplication: drop a span contained in a better
    span of the same type (higher score, or equal score and earlier/longer).
    Spans that contain one another lie in one island of the sorted spans."""
    def dominated(s, part):
        return F.exists(part, lambda o: (o["entity_type"] == s["entity_type"])
                        & (o["start"] <= s["start"]) & (o["end"] >= s["end"])
                        & ((o["score"] > s["score"])
                           | ((o["score"] == s["score"])
                              & ((o["start"] < s["start"]) | (o["end"] > s["end"])))))

    def by_island(sp):
        return F.flatten(F.transform(S.islands(S.sort_spans(sp)), lambda part: F.when(F.size(part) == 1, part)
                                     .otherwise(F.filter(part, lambda s: ~dominated(s, part)))))

    # few spans are compared at once: finding their islands takes longer
    return let(spans, lambda sp: F.when(F.size(sp).between(0, 1), sp).when(F.size(sp) <= FEW_SPANS, F.filter(sp, lambda s: ~dominated(s, sp)))
               .otherwise(by_island(sp)))


def with_recogniser_spans(df: DataFrame, text_col: str, context_col: str, out_col: str = "rec_spans",
                          patterns: Sequence[SpanPattern] = catalog.LAYER3_PATTERNS, raw: bool = False,
                          contexts: dict | None = None, context_words: dict[str, Sequence[str]] | None = None,
                          boost: float = CUSIP_CONTEXT_BOOST, boosted_least: float = CUSIP_CONTEXT_MIN_SCORE,
                          flags: str = RECOGNISER_FLAGS, given: str | None = None) -> DataFrame:
    """Layer 3 financial recognisers, only for contexts that request them.
    ``context_words`` (type -> words that raise its score), the ``boost``, the
    score that a raised span has at least, and the regex ``flags`` are arguments."""
    if context_words is None:
        context_words = {"CUSIP": catalog.CUSIP_CONTEXT_WORDS}
    pats = [_recogniser_pattern(p, flags) for p in patterns]
    # a recogniser whose type the row's context does not request is not run
    staged = S.with_pattern_spans(df, text_col, pats, "__rec_all", source=1, ord_offset=_L3_ORD, raw=raw,
                                  wanted=lambda et: F.array_contains(context_types(F.col(context_col), contexts), et), given=given)
    boosted = staged.withColumn(
        "__rec_boost", _context_boost(F.col("__rec_all"), F.col(text_col), context_words, boost, boosted_least))
    return boosted.withColumn(out_col, _drop_contained(F.col("__rec_boost"))).drop("__rec_all", "__rec_boost")


def _escaped(term: str) -> str:
    """A term as a pattern: every ASCII character but letters, digits and ``_``
    escaped, a word boundary where the term's edge is a word character."""
    body = "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in term)
    edge = lambda c: "\\b" if c.isalnum() or c == "_" else ""
    return f"{edge(term[0])}{body}{edge(term[-1])}"


def gazetteer_pattern(terms: Sequence[str], entity_type: str, score: float = 0.85) -> SpanPattern:
    """A bounded term list as one whole-word, case-insensitive alternation."""
    alts = "|".join(_escaped(t) for t in sorted({t for t in terms if t}, key=lambda x: (-len(x), x)))
    return SpanPattern(entity_type, f"(?i)(?:{alts})", score, 0)


def external_to_spans(ext: Column, text: Column, ord_offset: int = _EXT_ORD) -> Column:
    """Model-produced ``array<struct<entity_type,start,end,score>>`` -> spans."""
    return F.transform(F.coalesce(ext, F.array().cast(EXTERNAL_SPAN_TYPE)), lambda e, i: S.make_span(
        e["entity_type"], e["start"], e["end"], e["score"],
        F.substring(text, e["start"] + 1, e["end"] - e["start"]), 1, i + ord_offset))


def filter_recogniser_side(spans: Column, context: Column,
                           allow_terms: Sequence[str] = catalog.ALLOW_TERMS, contexts: dict | None = None) -> Column:
    """L9 context filter (pre-canonical names), L10 allow terms, then L4."""
    allowed = context_types(context, contexts)
    terms = F.array(*[F.lit(t) for t in allow_terms])
    kept = F.filter(spans, lambda s: F.array_contains(allowed, s["entity_type"])
                    & ~F.array_contains(terms, s["text"]))
    return F.transform(kept, lambda s: S.make_span(canonical_type(s["entity_type"]), s["start"], s["end"],
                                                    s["score"], s["text"], s["source"], s["ord"]))


def detect_spans(df: DataFrame, text_col: str = "text", context_col: str = "context",
                 out_col: str = "spans", *, raw: bool = True, normalize: bool = True,
                 layer1: Sequence[SpanPattern] = catalog.LAYER1_PATTERNS,
                 layer3: Sequence[SpanPattern] | None = catalog.LAYER3_PATTERNS,
                 gazetteer: Sequence[SpanPattern] = (),
                 external_col: str | None = None,
                 allow_patterns: Sequence[str] = catalog.ALLOW_PATTERNS,
                 allow_terms: Sequence[str] = catalog.ALLOW_TERMS,
                 contexts: dict | None = None, strict: bool = False) -> DataFrame:
    """N1 + R0 + L* + M1-M3 + A*: adds ``out_col`` = merged, allow-filtered
    spans (internal layout, sorted by start, non-overlapping).  Every
    catalogue (patterns, recognisers, gazetteer, allow patterns/terms,
    context -> requested types) is an argument.  ``strict``: overlaps are resolved
    by the best set of spans instead of the left fold, which can lose a span
    that nothing kept overlaps."""
    if context_col not in df.columns:
        df = df.withColumn(context_col, F.lit(catalog.DEFAULT_CONTEXT))
    # one pass through Python: what is normalised is not plain, so neither waits for the other
    text = F.col(text_col)
    recognisers = [_recogniser_pattern(p) for p in layer3 or ()]
    df = df.withColumn("__plain", marks.plain(text))
    scanned = F.when(F.col("__plain"), text)
    df = df.select("*", (composed(text) if normalize else F.lit(None).cast("string")).alias("__nfc"),
                   S.arrow_spans(scanned, layer1).alias("__f1"), S.arrow_spans(scanned, recognisers, 1, _L3_ORD).alias("__f3"))
    df = df.withColumn(text_col, F.coalesce("__nfc", text)).drop("__nfc", "__plain")
    df = S.with_layer1_spans(df, text_col, "__l1", layer1, raw=raw, given="__f1")
    rec_parts = []
    if layer3:
        df = with_recogniser_spans(df, text_col, context_col, "__l3", layer3, raw=raw, contexts=contexts, given="__f3")
        rec_parts.append(F.col("__l3"))
    if gazetteer:
        df = S.with_pattern_spans(df, text_col, list(gazetteer), "__gaz", source=1, ord_offset=_GAZ_ORD, raw=raw)
        rec_parts.append(F.col("__gaz"))
    if external_col:
        rec_parts.append(external_to_spans(F.col(external_col), F.col(text_col)))
    rec = F.concat(*rec_parts) if rec_parts else S.empty_spans()
    merged = (S.merge_best if strict else S.merge_fold)(S.sort_spans(F.concat(
        F.col("__l1"), filter_recogniser_side(rec, F.col(context_col), allow_terms, contexts))))
    temps = {"__l1", "__l3", "__f3", "__gaz", "__merged"}
    out = df.select("*", merged.alias("__merged"))
    return out.select(*[c for c in out.columns if c not in temps],
                      S.allow_filter(F.col("__merged"), allow_patterns).alias(out_col))


def detect(df: DataFrame, text_col: str = "text", context_col: str = "context", **kw) -> DataFrame:
    """P10 detect-only: public ``entities`` array, no sanitisation."""
    out = detect_spans(df, text_col, context_col, "__spans", **kw)
    return out.withColumn("entities", S.to_public(F.col("__spans"))).drop("__spans")
