"""Placeholder assignment, splice and manifest (P1-P11), plus the end-to-end
redact transform with its security envelope.

Per-document numbering is in-row (no shuffle): the first occurrence of each
exact text gets ``<TYPE_N>`` with N counting first occurrences of that type
in reading order; every later occurrence of the same text reuses it, even
when its own type differs.  The splice builds the output from an array of
pieces joined once, so it is linear in the text length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..functions.lets import before, let, running_sum
from . import audit, screen
from .detect import detect_spans
from .sanitize import sanitize

ENTRY_TYPE = T.StructType([
    T.StructField("placeholder", T.StringType()),
    T.StructField("original", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
MANIFEST_TYPE = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("redaction_id", T.StringType()),
    T.StructField("placeholders", T.ArrayType(ENTRY_TYPE)),
    T.StructField("stats", T.StructType([
        T.StructField("entities_found", T.IntegerType()),
        T.StructField("entities_by_type", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("text_length_original", T.IntegerType()),
        T.StructField("text_length_sanitized", T.IntegerType()),
    ])),
])


def _placeholders(spans: Column) -> Column:
    """Placeholder of every span, in the spans' order, in O(k log k).

    Equal texts are brought together by sorting (text, position); the head of
    each group is a first occurrence.  Heads sorted by (type, position) are
    numbered by their distance from the first one of their type; the numbers
    go back to the groups, and the groups' members back to their positions.
    """
    null_head = F.lit(None).cast("struct<text:string,i:int,entity_type:string>")

    def by_text(k):
        is_head = F.zip_with(k, before(k, null_head), lambda x, y: F.when(y.isNull() | (x["text"] != y["text"]), 1).otherwise(0))
        return let(is_head, lambda flags: number(k, flags))

    def number(k, flags):
        heads = F.array_compact(F.zip_with(k, flags, lambda x, f: F.when(f == 1, x)))
        by_type = F.sort_array(F.transform(heads, lambda x, g: F.struct(
            x["entity_type"].alias("t"), x["i"].alias("i"), g.alias("g"))))
        return let(by_type, lambda h: let(F.transform(h, lambda x: x["t"]), lambda types: spread(k, flags, h, types)))

    def spread(k, flags, h, types):
        first = F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(
            t.alias("k"), F.array_position(types, t).alias("v"))))  # one entry per type
        named = let(first, lambda at: F.sort_array(F.transform(h, lambda x, j: F.struct(
            x["g"].alias("g"), F.concat(F.lit("<"), x["t"], F.lit("_"), (j + 2 - F.element_at(at, x["t"])).cast("string"), F.lit(">")).alias("p")))))
        placed = let(named, lambda n: F.zip_with(k, running_sum(flags), lambda x, g: F.struct(
            x["i"].alias("i"), F.get(n, g - 1)["p"].alias("p"))))
        return F.transform(F.sort_array(placed), lambda x: x["p"])

    keyed = F.sort_array(F.transform(spans, lambda s, i: F.struct(
        s["text"].alias("text"), i.alias("i"), s["entity_type"].alias("entity_type"))))
    return F.when(F.size(spans) > 0, let(keyed, by_text)).otherwise(F.array().cast("array<string>"))


def number_spans(spans: Column) -> Column:
    """Spans (sorted by start) -> manifest entries, one per occurrence."""
    return let(spans, lambda sp: F.zip_with(sp, _placeholders(sp), lambda s, p: F.struct(
        p.alias("placeholder"), s["text"].alias("original"), s["entity_type"].alias("entity_type"),
        s["start"].alias("start"), s["end"].alias("end"))))


def with_entries(df: DataFrame, spans_col: str, out_col: str = "entries") -> DataFrame:
    return df.withColumn(out_col, number_spans(F.col(spans_col)))


def splice(text: Column, entries: Column) -> Column:
    """P5: replace every entry span by its placeholder (entries disjoint, sorted)."""
    def cut(x):
        ends = F.transform(x["entries"], lambda e: e["end"])
        pieces = F.zip_with(x["entries"], before(ends, F.lit(0)), lambda e, at: F.concat(
            F.substring(x["text"], at + 1, e["start"] - at), e["placeholder"]))
        rest = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)) + 1
        return F.concat(F.array_join(pieces, ""), F.substring(x["text"], rest, F.length(x["text"])))

    return let(F.struct(text.alias("text"), entries.alias("entries")), cut)


def type_histogram(entries: Column) -> Column:
    """Occurrences per type, keys in first-seen order."""
    def count(types):
        # sorted, a type's occurrences end where the next type's begin
        return let(F.sort_array(types), lambda s: F.map_from_entries(F.transform(F.array_distinct(types), lambda t: F.struct(
            t.alias("key"), (F.size(s) + 1 - F.array_position(s, t) - F.array_position(F.reverse(s), t) + 1).cast("int").alias("value")))))

    return let(F.transform(entries, lambda e: e["entity_type"]), count)


def redaction_id(id_col: Column, text: Column) -> Column:
    """``red_`` + 8 hex, deterministic in (id, text) so task retries agree."""
    return F.concat(F.lit("red_"), F.substring(F.sha2(F.concat_ws("\u0000", id_col.cast("string"), text), 256), 1, 8))


#: Column that names a row's manifest in the vault.
VAULT_KEY = "vault_key"


def vault_key(id_col: Column, text: Column) -> Column:
    """128 bits, deterministic in (id, text): what the vault is joined by."""
    return F.substring(F.sha2(F.concat_ws("\u0000", F.lit("vault"), id_col.cast("string"), text), 256), 1, 32)


def manifest(rid: Column, entries: Column, text: Column, sanitized: Column) -> Column:
    """The manifest struct (``to_json`` gives the serialised form)."""
    return F.struct(
        F.lit(catalog.MANIFEST_VERSION).alias("version"),
        rid.alias("redaction_id"),
        entries.alias("placeholders"),
        F.struct(
            F.size(entries).cast("int").alias("entities_found"),
            type_histogram(entries).alias("entities_by_type"),
            F.length(text).cast("int").alias("text_length_original"),
            F.length(sanitized).cast("int").alias("text_length_sanitized"),
        ).alias("stats"),
    )


def redact_spans(df: DataFrame, id_col: str, text_col: str, spans_col: str) -> DataFrame:
    """P1-P9 on already-detected spans: adds ``sanitized_text`` and ``manifest``."""
    df = with_entries(df, spans_col, "__entries")
    df = df.withColumn("sanitized_text", splice(F.col(text_col), F.col("__entries")))
    return df.withColumn("manifest", manifest(
        redaction_id(F.col(id_col), F.col(text_col)), F.col("__entries"), F.col(text_col),
        F.col("sanitized_text"))).drop("__entries")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", context_col: str = "context",
           *, envelope: bool = True, max_bytes: int | None = catalog.MAX_INPUT_BYTES,
           max_lines: int | None = catalog.MAX_LINE_COUNT, keep_text: bool = False, **detect_kw) -> DataFrame:
    """P11 end to end: sanitise -> screen -> NFC + detect -> number -> splice
    -> manifest -> output audit.

    Output: ``id, is_valid, error, sanitized_text, manifest, vault_key`` and, with
    ``envelope``, the security fields.  Rejected rows carry a null
    ``sanitized_text``/``manifest``/injection fields and their ``error``; they
    are never dropped.  The raw text is dropped, unless ``keep_text`` asks for the
    validated input.
    """
    if context_col not in df.columns:
        df = df.withColumn(context_col, F.lit(catalog.DEFAULT_CONTEXT))
    df = sanitize(df, text_col, max_bytes, max_lines)
    # only admitted rows are screened and scanned; rejected rows keep their text and error
    df = df.withColumn("_vtext", F.when(F.col("is_valid"), F.col(text_col)))
    if envelope:
        df = screen.screen(df, "_vtext")
        for c in ("injection_patterns", "injection_score", "injection_detected"):
            df = df.withColumn(c, F.when(F.col("is_valid"), F.col(c)))
    df = detect_spans(df, "_vtext", context_col, "__spans", raw=False, **detect_kw)
    df = redact_spans(df, id_col, "_vtext", "__spans").drop("__spans")
    df = df.withColumn("manifest", F.when(F.col("is_valid"), F.col("manifest")))
    df = df.withColumn(VAULT_KEY, F.when(F.col("is_valid"), vault_key(F.col(id_col), F.col("_vtext"))))
    df = df.withColumn(text_col, F.coalesce(F.col("_vtext"), F.col(text_col))).drop("_vtext") if keep_text else df.drop("_vtext", text_col)
    if envelope:
        df = audit.audit(df, "sanitized_text", "manifest")
        df = (df.withColumn("input_sanitized", F.size("actions") > 0)
                .withColumnRenamed("actions", "sanitization_actions"))
    return df
