"""Quality rules with thresholds that follow the data.

Counts per text come from SQL functions alone.  Each measure (in hundredths of
a percent) gets, per language and source, a quantile sketch: a histogram whose
buckets keep five leading bits of the value, so a bucket's ends differ by a
sixteenth at most.  Sketches merge by adding counts: the sketch of a language
is the sum over its sources, that of all rows the sum over its languages.  A
group's upper fence is its third quartile plus the larger of ``SPREAD`` times
its interquartile range and the measure's slack; groups of fewer than
``MIN_ROWS`` rows take the fence of their language, and if that is small too,
that of all rows.  Rows that pass the base rules and stay within every fence
are kept.

Defined results: null and empty texts have no words, so they fail the base
rules.  Null languages and sources form groups of their own.  Rows that fail
the base rules do not enter the sketches.  Repeated rows count each.  Of an
empty table there is an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh

SPREAD = 3
MIN_ROWS = 100
#: measure -> (expression over the counts, slack), in hundredths of a percent
MEASURES = {
    "symbols": ("10000 * n_symbols div greatest(word_chars, 1)", 500),
    "capitals": ("10000 * n_capitals div greatest(word_chars, 1)", 2500),
    "old_words": ("10000 * (n_words - n_distinct) div greatest(n_words, 1)", 1500),
    "old_lines": ("10000 * n_dup_lines div greatest(n_lines, 1)", 3000),
}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_distinct", "n_lines", "n_dup_lines", "n_repeat_words"]
# Java's class escapes, as in the contract's ``[^\x20\x09-\x0D]``.
_GAP = r"[\\x20\\x09-\\x0D]"


def _shifted(array: str, width: int, n: str) -> str:
    """The array beside itself moved on by 1 ... width-1: one struct per window."""
    return "arrays_zip(" + ", ".join(f"slice({array}, {i + 1}, {n} - {width - 1})" for i in range(width)) + ")"


def count_words(df: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``df`` plus the counts of ``_COUNTS``.

    Repeated windows are looked for by hash; only texts that have one compare
    the windows themselves.  Each step is a column of its own that the next
    one reads more than once, so none is evaluated inside another's lambda.
    """
    t, words, hs, lines, n, at, starts = fresh(df, "_t", "_words", "_hs", "_lines", "_n", "_at", "_starts")
    parts = ", ".join(f"x.`{i}`" for i in range(window))
    out = (
        df.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
        .withColumn(words, F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)))
        .withColumn(lines, F.expr(f"filter(split({t}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"))
        .withColumn(hs, F.expr(f"transform({words}, w -> xxhash64(w))"))
        .withColumn(n, F.expr(f"cast(size({words}) as int)"))
    )
    hashed = f"transform({_shifted(hs, window, n)}, x -> xxhash64({parts}))"
    # windows that occur again, by hash; then the sorted starts of those that really do
    again = (f"if({n} < {window + 1}, false, exists(array({hashed}), h -> size(array_distinct(h)) < size(h)))")
    text = f"transform({_shifted(words, window, n)}, x -> concat_ws(' ', {parts}))"
    sorted_ = f"array_sort(arrays_zip({text}, sequence(0, {n} - {window})))"
    pairs = "arrays_zip(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1))"
    same = f"filter({pairs}, p -> p.`0`.`0` = p.`1`.`0`)"
    starts_of = (f"flatten(transform(array({sorted_}), s -> array_sort(array_distinct(flatten(transform({same}, "
                 f"p -> array(p.`0`.`1`, p.`1`.`1`)))))))")
    covered = (f"if(size({starts}) > 0, {window} + aggregate(arrays_zip(slice({starts}, 1, size({starts}) - 1), "
               f"slice({starts}, 2, size({starts}) - 1)), 0, (a, x) -> a + least({window}, x.`1` - x.`0`)), 0)")
    out = (
        out.withColumn(at, F.expr(again))
        .withColumn(starts, F.expr(f"if({at}, {starts_of}, cast(array() as array<int>))"))
        .withColumn("n_words", F.col(n).cast("long"))
        .withColumn("word_chars", F.expr(f"cast(length(regexp_replace({t}, '{_GAP}+', '')) as long)"))
        .withColumn("n_symbols", F.expr(f"cast(length({t}) - length(translate({t}, '#*$%&|<>', '')) as long)"))
        .withColumn("n_capitals", F.expr(f"cast(regexp_count({t}, '[\\\\p{{Lu}}]') as long)"))
        .withColumn("n_distinct", F.expr(f"cast(size(array_distinct({hs})) as long)"))
        .withColumn("n_lines", F.expr(f"cast(size({lines}) as long)"))
        .withColumn("n_dup_lines", F.expr(f"cast(size({lines}) - size(array_distinct({lines})) as long)"))
        .withColumn("n_repeat_words", F.expr(f"cast({covered} as long)"))
    )
    return out.drop(t, words, hs, lines, n, at, starts)


def base_failed() -> F.Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _bucket(v: str) -> str:
    """Bucket of a value: itself below 32, else its bit length and five leading bits."""
    drop = f"(length(bin({v})) - 5)"
    return f"if({v} < 32, {v}, 16 + 16 * {drop} + (shiftright({v}, {drop}) - 16))"


def _bucket_top(b: str) -> str:
    """The largest value of a bucket."""
    drop = f"cast(({b} - 16) div 16 as int)"
    return f"if({b} < 32, {b}, shiftleft(17 + ({b} - 16) % 16, {drop}) - 1)"


def sketches(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """``(lang, source, measure, bucket, n)`` of the rows that pass the base rules."""
    values = F.expr("array(" + ", ".join(
        f"named_struct('measure', '{m}', 'v', cast({e} as long))" for m, (e, _) in MEASURES.items()) + ")")
    one = counts.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(values))
    return one.select("lang", "source", "measure", F.expr(f"cast({_bucket('v')} as long)").alias("bucket")) \
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Upper fence and rows per group and measure; sketches of finer groups are merged first."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    top = F.expr(_bucket_top("bucket"))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * k, top))
    slack = reduce(lambda c, m: c.when(F.col("measure") == m, MEASURES[m][1]), MEASURES, F.when(F.lit(False), 0))
    q = upto.groupBy(*keys, "measure").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("rows").alias("rows"))
    return q.select(*keys, "measure", "rows", (F.col("q3") + F.greatest(SPREAD * (F.col("q3") - F.col("q1")), slack)).alias("fence"))


def thresholds(counts: DataFrame, lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS,
               scratch: Scratch | None = None) -> DataFrame:
    """One row per (lang, source) that occurs: a fence per measure."""
    scratch = scratch or Scratch(counts.sparkSession, "rules")
    sketch = scratch.cut(sketches(counts, lang, source))
    own, by_lang, all_ = (fences(sketch, k) for k in (["lang", "source"], ["lang"], []))
    joined = (
        own.alias("o")
        .join(by_lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")) & (F.col("o.measure") == F.col("l.measure")))
        .join(all_.alias("a"), F.col("o.measure") == F.col("a.measure"))
        .select("o.lang", "o.source", "o.measure", F.when(F.col("o.rows") >= min_rows, F.col("o.fence"))
                .when(F.col("l.rows") >= min_rows, F.col("l.fence")).otherwise(F.col("a.fence")).alias("fence"))
    )
    return joined.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES])


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per input row: id, language, source, counts, measures, fences, ``base_failed``, ``kept``."""
    scratch = Scratch(df.sparkSession, "rules")
    counted = count_words(df.select(F.col(id_col), F.col(text_col).alias("_text"), F.col(lang_col).alias("lang"),
                                    F.col(source_col).alias("source")), "_text")
    counts = scratch.cut(counted.drop("_text"))
    limits = scratch.cut(thresholds(counts, min_rows=min_rows, scratch=scratch)
                         .withColumnsRenamed({"lang": "_l", "source": "_s"}))
    out = counts.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left") \
        .drop("_l", "_s")
    for m, (e, _) in MEASURES.items():
        out = out.withColumn(m, F.expr(f"cast({e} as long)"))
    within = reduce(lambda a, b: a & b, [F.col(m) <= F.col(f"max_{m}") for m in MEASURES])
    return out.withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
