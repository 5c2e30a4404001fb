"""Output validation / leak audit.

Works on the typed manifest struct produced by ``redact`` and on untyped
JSON manifests (parsed as VARIANT, so "not a list" / "not an object" can be
told apart from a typed null).  Warnings keep the specified order: manifest
structure, then one leak warning per entry, then malformed placeholders in
text order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from .gazetteer import dictionary_spans
from ..functions import dialect

_SHAPE = dialect.java_fullmatch(catalog.PLACEHOLDER_SHAPE)


def quote_literal(s: Column) -> Column:
    """Java regex literal quoting of a column value (``\\Q...\\E``)."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def leak_found(text: Column, original: Column) -> Column:
    """The original, word-bounded, still present in the output."""
    pattern = F.concat(F.lit("(?U)\\b"), quote_literal(original), F.lit("\\b"))
    # substring test first: the per-entry regex is compiled only when the
    # original occurs at all (rare in redacted output)
    present = text.contains(original)
    return F.when((F.length(original) >= catalog.MIN_LEAK_CHECK_LENGTH) & present,
                  F.rlike(text, pattern)).otherwise(F.lit(False))


def malformed_placeholders(text: Column) -> Column:
    """Every ``<...>`` in the output that is not ``<TYPE_N>``."""
    found = F.regexp_extract_all(text, F.lit("<[^>]+>"), 0)
    return F.transform(F.filter(found, lambda x: ~x.rlike(_SHAPE)),
                       lambda x: F.concat(F.lit("invalid_placeholder_format:"), x))


def _warnings(text: Column, structure: Column, entry_warnings: Column) -> Column:
    return F.concat(structure, entry_warnings, malformed_placeholders(text))


def audit(df: DataFrame, text_col: str = "sanitized_text", manifest_col: str = "manifest") -> DataFrame:
    """Typed manifest: adds ``output_valid`` and ``output_warnings``."""
    m = F.col(manifest_col)
    text = F.col(text_col)
    entries = F.coalesce(m["placeholders"], F.array())
    structure = F.array_compact(F.array(
        F.when(m["placeholders"].isNull(), F.lit("manifest_missing_placeholders")),
        F.when(m["version"].isNull(), F.lit("manifest_missing_version")),
        F.when(m["redaction_id"].isNull(), F.lit("manifest_missing_redaction_id")),
    ))
    leaks = F.transform(
        F.filter(entries, lambda e: leak_found(text, F.coalesce(e["original"], F.lit("")))),
        lambda e: F.concat(F.lit("pii_leak:"), F.coalesce(e["entity_type"], F.lit("UNKNOWN"))))
    w = F.when(m.isNotNull(), _warnings(text, structure, leaks))
    return df.withColumn("output_warnings", w).withColumn("output_valid", F.size("output_warnings") == 0)


def audit_json(df: DataFrame, text_col: str, manifest_json_col: str) -> DataFrame:
    """Untyped JSON manifest (``validate_output`` on a dict)."""
    v = F.try_parse_json(F.col(manifest_json_col))
    keys = F.coalesce(F.json_object_keys(F.col(manifest_json_col)), F.array())
    staged = df.withColumn("__v", v).withColumn("__keys", keys)
    ph = F.try_variant_get(F.col("__v"), "$.placeholders", "variant")
    has_ph = F.array_contains(F.col("__keys"), "placeholders")
    is_list = F.schema_of_variant(ph).startswith("ARRAY")
    entries = F.try_variant_get(F.col("__v"), "$.placeholders", "array<variant>")
    structure = F.array_compact(F.array(
        F.when(~has_ph, F.lit("manifest_missing_placeholders")),
        F.when(~F.array_contains(F.col("__keys"), "version"), F.lit("manifest_missing_version")),
        F.when(~F.array_contains(F.col("__keys"), "redaction_id"), F.lit("manifest_missing_redaction_id")),
    ))
    text = F.col(text_col)

    def entry_warning(e, i):
        is_obj = F.schema_of_variant(e).startswith("OBJECT")
        original = F.coalesce(F.try_variant_get(e, "$.original", "string"), F.lit(""))
        etype = F.coalesce(F.try_variant_get(e, "$.entity_type", "string"), F.lit("UNKNOWN"))
        return (F.when(~is_obj, F.concat(F.lit("manifest_entry_"), i.cast("string"), F.lit("_not_dict")))
                .when(leak_found(text, original), F.concat(F.lit("pii_leak:"), etype)))

    entry_w = F.array_compact(F.transform(F.coalesce(entries, F.array()), entry_warning))
    not_list = F.concat(structure, F.array(F.lit("manifest_placeholders_not_list")))
    warnings = F.when(has_ph & ~is_list, not_list).otherwise(_warnings(text, structure, entry_w))
    return (staged.withColumn("output_warnings", warnings)
            .withColumn("output_valid", F.size("output_warnings") == 0).drop("__v", "__keys"))


def leaks_across_rows(outputs: DataFrame, vault: DataFrame, id_col: str = "doc_id", text_col: str = "sanitized_text", key: bytes | None = None,
                      min_length: int = catalog.MIN_LEAK_CHECK_LENGTH) -> DataFrame:
    """X5 over a corpus: values redacted in some row that stand in any output.

    ``vault(original, entity_type)`` -> ``(id, entity_type, start, end)``: the
    vault's distinct values of ``min_length`` and more are a dictionary, whose
    keyed hashes are joined with those of the outputs' word windows.  The
    values themselves are not in the result."""
    values = vault.where(F.length("original") >= min_length).select(F.col("original").alias("term"), "entity_type").distinct().withColumn("score", F.lit(1.0))
    # by id, so that what is counted by document afterwards lies together already
    return dictionary_spans(outputs, values, id_col, text_col, key=key).drop("score").repartition(id_col).distinct()
