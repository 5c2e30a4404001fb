"""Placeholders with the scope of a conversation (or any other group of rows).

The same value gets the same placeholder in every row of its scope; numbers
count first occurrences per type in the order of ``order_col``, then of the
rows as they were written, then of position.

Detection runs once: rows with their spans are written to the shared folder
with a row id of their own, so repeated (scope, order) keys stay apart and a
retry sees the same ids.  Numbering then shuffles one row per distinct value;
a scope of any size is numbered by many tasks (``ranking.with_rank``).
Rows of a null scope form one scope.  Rows without spans keep their text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rows import explode_rows
from ..session import checkpoint_dir
from .detect import detect_spans
from .ranking import with_rank
from .redact import ENTRY_TYPE, splice


def conversation_entries(df: DataFrame, scope_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
                         context_col: str = "context", **detect_kw) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_row`` and normalised text, entries ``(_row, start, end, entity_type, original, placeholder)``)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/conversations-{uuid.uuid4().hex}"
    detect_spans(df, text_col, context_col, "_spans", **detect_kw).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    found = explode_rows(rows, ["_row", F.col(scope_col).alias("_scope"), F.col(order_col).alias("_order")], "_spans", "s").select(
        "_row", "_scope", "_order", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.col("s.entity_type").alias("entity_type"), F.col("s.text").alias("original"))
    first = found.groupBy("_scope", "original").agg(F.min(F.struct("_order", "_row", "start", "entity_type")).alias("f"))
    placed = with_rank(first.select("_scope", "original", "f.entity_type", "f._order", "f._row", "f.start"),
                       ["_scope", "entity_type"], ["_order", "_row", "start"], "_n")
    named = placed.select(F.col("_scope").alias("_s"), F.col("original").alias("_o"), F.format_string(
        "<%s_%d>", "entity_type", "_n").alias("placeholder"))
    entries = found.join(named, F.col("_scope").eqNullSafe(F.col("_s")) & (F.col("original") == F.col("_o"))) \
        .select("_row", "start", "end", "entity_type", "original", "placeholder")
    return rows.drop("_spans"), entries


def redact_conversations(df: DataFrame, scope_col: str = "conv_id", order_col: str = "turn", text_col: str = "text",
                         context_col: str = "context", **detect_kw) -> DataFrame:
    """``df`` plus ``sanitized_text`` and ``placeholders`` (manifest entries in reading order)."""
    keep = [c for c in df.columns if c not in ("sanitized_text", "placeholders")]
    rows, entries = conversation_entries(df.select(*keep), scope_col, order_col, text_col, context_col, **detect_kw)
    per_row = entries.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "end", "placeholder", "original", "entity_type"))).alias("_e"))
    kind = f"array<{ENTRY_TYPE.simpleString()}>"
    out = rows.join(per_row, "_row", "left").withColumn("placeholders", F.coalesce(F.transform("_e", lambda e: F.struct(
        e["placeholder"].alias("placeholder"), e["original"].alias("original"), e["entity_type"].alias("entity_type"),
        e["start"].alias("start"), e["end"].alias("end"))), F.array()).cast(kind))
    return out.withColumn("sanitized_text", splice(F.col(text_col), F.col("placeholders"))) \
        .select(*keep, "sanitized_text", "placeholders")
