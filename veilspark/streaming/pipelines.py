"""Streaming forms of the document operators.

Redaction, detection and screening are per-row projections, so on a stream
they are map-only queries with no state and no watermark: exactly the batch
expressions applied to each micro-batch.  Windowed rates (X8) add a
watermark and an event-time window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..operators.redact import redact
from ..operators.screen import screen


def redact_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  context_col: str = "context") -> DataFrame:
    """Map-only streaming redaction: sanitized text + manifest per document."""
    r = redact(docs, id_col=id_col, text_col=text_col, context_col=context_col)
    return r.select(id_col, "is_valid", "error", "sanitized_text", "manifest", "injection_score",
                    "output_valid")


def detect_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context_col: str = "context") -> DataFrame:
    """Map-only streaming detection: the entities of each document."""
    return detect(docs, text_col, context_col).select(id_col, "entities")


def screen_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Map-only streaming injection screening."""
    return screen(docs, text_col).select(id_col, "injection_patterns", "injection_score", "injection_detected")


def windowed_rate(events: DataFrame, ts_col: str, flag_col: str, window: str = "1 day",
                  watermark: str = "1 day", group_cols: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Per event-time window (sliding by ``slide``): number of rows and number with ``flag_col`` true."""
    w = events.withWatermark(ts_col, watermark)
    return (w.groupBy(F.window(ts_col, window, slide), *group_cols)
            .agg(F.count("*").alias("n"), F.sum(F.col(flag_col).cast("long")).alias("n_flagged")))


def session_rate(events: DataFrame, ts_col: str, key_col: str, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """Rows, first and last time of each key's sessions: rows less than ``gap`` apart.
    A session comes out once the watermark has passed its end; until then a
    late row may extend it or join two."""
    w = events.withWatermark(ts_col, watermark)
    return (w.groupBy(F.session_window(ts_col, gap), key_col)
            .agg(F.count("*").alias("n"), F.min(ts_col).alias("first"), F.max(ts_col).alias("last")))
