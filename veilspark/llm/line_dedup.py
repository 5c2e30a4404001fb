"""Removal of repeated line runs by a suffix array over line ids.

Every line gets an id; only lines that occur again can be part of a repeated
run, so the others end the sequences.  The suffixes of these sequences are
ranked by prefix doubling: the ranks of round k order them by their first 2^k
lines, those of round k+1 come from sorting the pairs (rank here, rank 2^k
lines on).  Suffixes of equal rank form the longest-common-prefix interval of
that depth; intervals of one suffix are dropped, so that ever fewer positions
take part.

A run of lines with at least ``min_words`` words that occurs at two places is
removed from all but the first, in the order of id, text hash and line.  Every
such run is the union of shortest windows of ``min_words`` words, taken
forwards from its lines and backwards from its lines, and these recur with it.
A window of m lines is identified by its length and two overlapping blocks of
2^k <= m lines, whose ranks say in which interval it lies.  Windows that are
not the first of their interval are merged into maximal runs and deleted.
A line's first occurrence is never deleted.

Lines are told apart by 128 bits of hash.  Windows over one document's lines
are as large as the document; everything else is dealt out by line, rank or
window, and summed before the shuffle.

Defined results: null texts stay null, empty ones empty; a text that loses all
lines becomes empty.  Rows of equal id and text are one document: they keep
the same lines.  Null ids sort first.  An empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: A run of that many words that occurs again is a copy; blank lines alone are none.
MIN_WORDS = 1
#: A window's first place is sent to so many tasks, its copies to one of them each.
SALTS = 8
_POS = ["id", "th", "line"]


def _named(counted: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``keys`` that occur more than once, with ids in the order of the keys."""
    again = counted.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return scratch.cut(again.orderBy(*keys).withColumn("name", F.monotonically_increasing_id()))


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    cut = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.struct(
        F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"),
        F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"),
                     F.posexplode(cut).alias("line", "x")).select(*_POS, "x.h1", "x.h2", "x.w")


def _windows(s: DataFrame, min_words: int) -> DataFrame:
    """Shortest windows of ``min_words`` words within each sequence of repeated lines: ``(id, th, line, m)``."""
    doc = Window.partitionBy("id", "th")
    once = s.withColumn("before", F.lag("line").over(doc.orderBy("line"))).where("before is null or before <> line")
    seq = once.withColumn("seq", F.col("line") - F.row_number().over(doc.orderBy("line")))
    own = Window.partitionBy("id", "th", "seq")
    sums = seq.withColumn("upto", F.sum("w").over(own.orderBy("line"))).withColumn("ahead", F.col("upto") - F.col("w")) \
        .withColumn("all_words", F.sum("w").over(own)).withColumn("first", F.min("line").over(own)).withColumn("last", F.max("line").over(own))
    # First line with at least min_words words before it since this one; last line that leaves as many up to this one.
    after = Window.partitionBy("id", "th", "seq").orderBy(F.col("ahead").desc()).rangeBetween(Window.unboundedPreceding, -min_words)
    back = Window.partitionBy("id", "th", "seq").orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    found = sums.withColumn("end", F.coalesce(F.min("line").over(after), F.when(
        F.col("all_words") - F.col("ahead") >= min_words, F.col("last") + 1))) \
        .withColumn("start", F.coalesce(F.max("line").over(back) + 1, F.when(F.col("upto") >= min_words, F.col("first"))))
    both = F.array(F.struct(F.col("line"), (F.col("end") - F.col("line")).alias("m")),
                   F.struct(F.col("start").alias("line"), (F.col("line") + 1 - F.col("start")).alias("m")))
    return found.select("id", "th", F.inline(both)).where("m is not null").distinct()


def _same(a: str, b: str) -> F.Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _later(w: DataFrame, ranks: DataFrame, size: int) -> DataFrame:
    """Windows of size ... 2 * size - 1 lines that have an earlier copy."""
    here, there = ranks.select(*_POS, F.col("r").alias("ra")), ranks.select(*_POS, F.col("r").alias("rb"))
    known = (
        w.alias("w").join(here.alias("a"), _same("w", "a") & (F.col("w.line") == F.col("a.line")))
        .join(there.alias("b"), _same("w", "b") & (F.col("w.line") + F.col("w.m") - size == F.col("b.line")))
        .select("w.id", "w.th", "w.line", "w.m", "ra", "rb"))
    at = F.struct("id", "th", "line")
    first = known.groupBy("m", "ra", "rb").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = known.withColumn("salt", F.pmod(F.xxhash64("id", "th", "line"), F.lit(SALTS)).cast("int"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(first, ["m", "ra", "rb", "salt"]).where(~at.eqNullSafe(F.col("at"))).select("id", "th", "line", "m")


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  scratch: Scratch | None = None) -> DataFrame:
    """Maximal runs to delete: ``(id, th, start, end)``, ``end`` exclusive; ``th`` is the text's hash."""
    scratch = scratch or Scratch(df.sparkSession, "lines")
    lines = scratch.cut(_lines(df, id_col, text_col))
    names = _named(lines, ["h1", "h2"], scratch)
    ranks = scratch.cut(lines.join(names, ["h1", "h2"]).select(*_POS, "w", F.col("name").alias("r")))
    windows = scratch.cut(_windows(ranks, min_words).withColumn("level", F.expr("length(bin(m)) - 1")))
    top = windows.agg(F.max("level")).first()[0]
    found = windows.select("id", "th", "line", "m").where(F.lit(False))
    for k in range(0 if top is None else top + 1):
        size = 1 << k
        found = found.unionByName(scratch.cut(_later(windows.where(F.col("level") == k).drop("level"), ranks, size)))
        if k < top:
            ahead = Window.partitionBy("id", "th").orderBy("line").rangeBetween(size, size)
            pairs = ranks.select(*_POS, "r", F.max("r").over(ahead).alias("r2")).where("r2 is not null")
            names = _named(pairs, ["r", "r2"], scratch)
            ranks = scratch.cut(pairs.join(names, ["r", "r2"]).select(*_POS, F.col("name").alias("r")))
    doc = Window.partitionBy("id", "th").orderBy("line", "m")
    reach = found.withColumn("end", F.col("line") + F.col("m")).withColumn(
        "before", F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    return reach.withColumn("run", F.sum(F.when(F.col("line") > F.coalesce("before", F.lit(-1)), 1).otherwise(0)).over(doc)) \
        .groupBy("id", "th", "run").agg(F.min("line").alias("start"), F.max("end").alias("end")).drop("run")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the text without later copies, plus ``n_lines`` (before) and ``n_removed``."""
    scratch = Scratch(df.sparkSession, "lines")
    runs = scratch.cut(repeated_runs(df, id_col, text_col, min_words, scratch).groupBy("id", "th").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")))
    th, lines, bounds = fresh(df, "_th", "_lines", "_bounds")
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    # The runs grow with the corpus, so both sides are dealt out by document at every size.
    joined = df.withColumn(th, F.xxhash64(F.col(text_col))).alias("d").join(
        runs.hint("merge").alias("r"), F.col(f"d.{id_col}").eqNullSafe(F.col("r.id")) & (F.col(f"d.{th}") == F.col("r.th")), "left")
    split = joined.select("d.*", F.when(F.col("r.runs").isNotNull(), F.split(F.col(f"d.{text_col}"), "\n")).alias(lines), F.col("r.runs").alias(bounds))
    n = F.when(F.col(text_col).isNull(), 0).when(
        F.col(lines).isNull(), F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1).otherwise(F.size(lines))
    # What stands between the runs.
    gaps = (f"arrays_zip(concat(array(0), transform({bounds}, x -> x.end)), "
            f"concat(transform({bounds}, x -> x.start), array(size({lines}))))")
    kept = F.expr(f"array_join(flatten(transform({gaps}, g -> slice({lines}, g.`0` + 1, g.`1` - g.`0`))), '\\n')")
    gone = F.expr(f"coalesce(aggregate({bounds}, 0, (a, x) -> a + x.end - x.start), 0)")
    return split.select(*[F.when(F.col(bounds).isNull(), F.col(text_col)).otherwise(kept).alias(text_col) if c == text_col
                          else F.col(c) for c in keep], n.cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))
