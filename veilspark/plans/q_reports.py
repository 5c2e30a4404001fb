"""Corpus-level reports (X2-X4) and conversation-scope placeholders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators.conversation import conversation_entries, redact_conversations
from ..operators import reports
from ..session import checkpoint_dir
from ..sources import notes as N
from ..sources import tables
from . import sqlgen
from ..functions.rows import explode_rows
from .registry import register

_DOCS_SRC = "(SELECT doc_id, nfc_normalize(text) AS text, 'general' AS context, lang, source FROM documents)"
_DOCS_DET = sqlgen.detect_sql(_DOCS_SRC, "doc_id", "text", "context")


def detected_documents(spark, sf) -> DataFrame:
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return D.detect_spans(d, "text", "context", "sp", raw=True)


_ROLLUP_SQL = f"""SELECT d.lang, d.source, x.et AS entity_type, CAST(count(*) AS BIGINT) AS n
FROM {_DOCS_DET} x JOIN documents d ON d.doc_id = x.id
GROUP BY ROLLUP (d.lang, d.source, x.et)"""


@register("pii_profile_rollup", _ROLLUP_SQL)
def pii_profile_rollup(spark, sf):
    """Detected entities by language x source x type with subtotals."""
    return reports.profile(detected_documents(spark, sf), ["lang", "source"], "sp")


_TOP_SQL = f"""SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(count(x.id) AS BIGINT) AS n_entities
FROM documents d LEFT JOIN {_DOCS_DET} x ON x.id = d.doc_id
GROUP BY d.doc_id ORDER BY n_entities DESC, doc_id ASC LIMIT 10"""


@register("top_sensitive_docs", _TOP_SQL)
def top_sensitive_docs(spark, sf):
    """The ten documents with most detected entities (top-k is the
    feature; ties by id)."""
    return reports.most_sensitive(detected_documents(spark, sf), 10, spans_col="sp")


_NOTES = f"({N.notes_sql()})"
_REPEAT_SQL = f"""SELECT sha256(x) AS value_hash, et AS entity_type, CAST(count(*) AS BIGINT) AS n,
       CAST(count(DISTINCT id) AS BIGINT) AS n_notes
FROM {sqlgen.detect_sql(_NOTES)} GROUP BY x, et HAVING count(DISTINCT id) > 1"""


@register("repeated_values", _REPEAT_SQL)
def repeated_values(spark, sf):
    """Sensitive values seen in more than one note, reported by hash only."""
    d = D.detect_spans(N.notes(spark, sf), "text", "context", "sp", raw=True)
    return reports.repeated_values(d, "note_id", "sp").withColumnRenamed("n_rows", "n_notes")


# ------------------------------------------------------ conversation scope
def _conv_text(text, conv, turn, role):
    """Conversation turns enriched with contact details that recur across
    the turns of a conversation (the raw turns carry none)."""
    email = F.concat(F.lit("client"), conv.cast("string"), F.lit("@example.com"))
    phone = F.concat(F.lit("(212) 555-"), F.lpad((conv % 10000).cast("string"), 4, "0"))
    return F.concat(text, F.when(role == "user", F.concat(F.lit(" Reach me at "), email))
                    .otherwise(F.concat(F.lit(" Noted: "), email, F.lit(" and "), phone)),
                    F.lit(" Ref SSN "), F.lpad(((conv * 7919 + turn) % 1000000000).cast("string"), 9, "0"), F.lit("."))


_CONV_SQL_SRC = """(SELECT conv_id, turn, conv_id * 1000000 + turn AS row_id, text || CASE WHEN role = 'user'
   THEN ' Reach me at ' || 'client' || CAST(conv_id AS VARCHAR) || '@example.com'
   ELSE ' Noted: ' || 'client' || CAST(conv_id AS VARCHAR) || '@example.com' || ' and ' || '(212) 555-'
        || lpad(CAST(conv_id % 10000 AS VARCHAR), 4, '0') END
   || ' Ref SSN ' || lpad(CAST((conv_id * 7919 + turn) % 1000000000 AS VARCHAR), 9, '0') || '.' AS text,
   'general' AS context FROM conversations)"""

_CONV_PICK = """SELECT CAST(d.conv_id AS BIGINT) AS conv_id, CAST(d.turn AS BIGINT) AS turn, CAST(d.s AS BIGINT) AS pos_start,
       '<' || n.fet || '_' || CAST(n.num AS VARCHAR) || '>' AS placeholder, d.et AS entity_type"""

_CONV_SQL = f"""WITH d AS (SELECT c.conv_id, c.turn, x.s, x.e, x.et, x.x
           FROM {sqlgen.detect_sql(_CONV_SQL_SRC, 'row_id', 'text', 'context')} x
           JOIN {_CONV_SQL_SRC} c ON c.row_id = x.id),
f AS (SELECT conv_id, x, arg_min(et, turn * 100000000 + s) AS fet, min(turn * 100000000 + s) AS fpos
      FROM d GROUP BY conv_id, x),
n AS (SELECT conv_id, x, fet, row_number() OVER (PARTITION BY conv_id, fet ORDER BY fpos) AS num FROM f)
{_CONV_PICK}
FROM d JOIN n ON n.conv_id = d.conv_id AND n.x = d.x"""


_SKETCH_SQL = f"""SELECT x.et AS entity_type, CAST(count(*) AS BIGINT) AS n, true AS distinct_within, true AS top_within
FROM {sqlgen.detect_sql(_NOTES)} x GROUP BY x.et"""


@register("sketched_values", _SKETCH_SQL)
def sketched_values(spark, sf):
    """X2 / X4 from stored sketches per month, context and type, merged over the
    whole period: counts are exact; distinct values and the counts of the most
    frequent ones are checked against exact rows (5 %).  Notes are detected once:
    their spans are a written table, without texts, that both sides read."""
    kept = f"{checkpoint_dir(spark).rstrip('/')}/tables/spans-{uuid.uuid4().hex}"
    D.detect_spans(N.notes(spark, sf), "text", "context", "sp", raw=True).select("note_id", "context", F.transform(
        "sp", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["text"].alias("text"))).alias("sp")).write.parquet(kept)
    d = spark.read.parquet(kept)
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("note_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/sketches-{uuid.uuid4().hex}"
    reports.value_sketches(d.join(o, "note_id"), ["month", "context"], "sp").write.parquet(path)
    merged = reports.merged_sketches(spark.read.parquet(path), [])
    exact = explode_rows(d, [], "sp", "s").groupBy(F.col("s.entity_type").alias("entity_type"), F.sha2("s.text", 256).alias("v")).agg(F.count("*").alias("c"))
    sizes = exact.groupBy("entity_type").agg(F.count("*").alias("exact"), F.max("c").alias("most"))
    j = merged.join(sizes, "entity_type")
    near = lambda a, b, total: F.abs(a - b) <= 0.05 * total + 1
    return j.select("entity_type", F.col("n").cast("bigint").alias("n"), near(F.col("n_distinct"), F.col("exact"), F.col("exact")).alias("distinct_within"),
                    near(F.get("top", 0)["count"], F.col("most"), F.col("n")).alias("top_within"))


def _conversations(spark, sf) -> DataFrame:
    c = tables.conversations(spark, sf)
    return c.select("conv_id", "turn", _conv_text(F.col("text"), F.col("conv_id"), F.col("turn"), F.col("role"))
                    .alias("text"), F.lit("general").alias("context"))


@register("conversation_placeholders", _CONV_SQL)
def conversation_placeholders(spark, sf):
    """Numbering scoped to a conversation: the same text gets the same
    placeholder in every turn; counters run in (turn, offset) order."""
    rows, e = conversation_entries(_conversations(spark, sf))
    return e.join(rows.select("_row", "conv_id", "turn"), "_row").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("start").cast("bigint").alias("pos_start"), "placeholder", "entity_type")


_CONV_REDACT_SQL = f"""WITH p AS (SELECT conv_id, turn, s, e, '<' || fet || '_' || CAST(num AS VARCHAR) || '>' AS ph,
       lag(e, 1, 0) OVER (PARTITION BY conv_id, turn ORDER BY s) AS before FROM ({_CONV_SQL.replace(_CONV_PICK, "SELECT d.conv_id, d.turn, d.s, d.e, n.fet, n.num")})),
src AS (SELECT conv_id, turn, nfc_normalize(text) AS text FROM {_CONV_SQL_SRC}),
agg AS (SELECT p.conv_id, p.turn, string_agg(substring(src.text, before + 1, s - before) || ph, '' ORDER BY s) AS head, max(e) AS last
        FROM p JOIN src ON src.conv_id = p.conv_id AND src.turn = p.turn GROUP BY p.conv_id, p.turn)
SELECT src.conv_id, src.turn, coalesce(head, '') || substring(src.text, CAST(coalesce(last, 0) + 1 AS BIGINT)) AS sanitized_text
FROM src LEFT JOIN agg ON src.conv_id = agg.conv_id AND src.turn = agg.turn"""


@register("conversation_redact", _CONV_REDACT_SQL)
def conversation_redact(spark, sf):
    """X3 end to end: per-turn sanitized text with conversation-wide placeholders."""
    return redact_conversations(_conversations(spark, sf)).select("conv_id", "turn", "sanitized_text")


_PII_WINDOW_SQL = f"""SELECT strftime(o.o_orderdate, '%Y-%m') AS month, x.et AS entity_type, CAST(count(*) AS BIGINT) AS n
FROM {sqlgen.detect_sql(_NOTES)} x JOIN orders o ON o.o_orderkey = x.id
GROUP BY 1, 2"""


@register("pii_rate_window", _PII_WINDOW_SQL)
def pii_rate_window(spark, sf):
    """Detected entities per event-time month (the note's order date) and
    type; the spans are counted per note before the join, so only one small
    row per (note, type) meets the orders table."""
    d = D.detect_spans(N.notes(spark, sf), "text", "context", "sp", raw=True)
    per_note = explode_rows(d, ["note_id"], "sp", "s").groupBy(
        "note_id", F.col("s.entity_type").alias("entity_type")).count()
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("note_id"),
                                                  F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return per_note.join(o, "note_id").groupBy("month", "entity_type").agg(
        F.sum("count").cast("bigint").alias("n"))
