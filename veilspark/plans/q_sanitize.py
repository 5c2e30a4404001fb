"""Sanitisation queries (V1-V10, N1) over the dirty-documents view and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..functions import dialect
from ..operators import normalize
from ..operators.sanitize import rejection, sanitize
from ..sources import dirty, tables
from . import sqlgen
from ..functions.rows import explode_rows
from .registry import register

DIRTY = f"({dirty.dirty_documents_sql()})"
lit = dialect.sql_literal


def _step_query(name: str, label: str):
    from ..operators.sanitize import steps
    idx = [lab for lab, _ in steps()].index(label)
    _lab, rewrites = steps()[idx]
    fn = sqlgen.sanitize_step_fns()[idx][1]
    sql = (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, t1 AS text_out, (t1 <> text) AS changed "
           f"FROM (SELECT doc_id, text, {fn('text')} AS t1 FROM {DIRTY})")

    def q(spark, sf):
        d = dirty.dirty_documents(spark, sf)
        expr = F.col("text")
        for rx, rep in rewrites:
            expr = F.regexp_replace(expr, rx, rep)
        out = d.select("doc_id", "text", expr.alias("text_out"))
        return out.select("doc_id", "text_out", (F.col("text_out") != F.col("text")).alias("changed"))

    q.__doc__ = f"Sanitiser step '{label}' alone over the dirty-documents view."
    register(name, sql)(q)


_step_query("sanitize_control", "stripped_control_chars")
_step_query("sanitize_invisible", "stripped_invisible_unicode")
_step_query("sanitize_base64", "removed_base64_blocks")
_step_query("sanitize_md_images", "removed_external_images")
_step_query("sanitize_whitespace", "normalized_whitespace")


_HTML_SQL = (
    "SELECT CAST(page_id AS BIGINT) AS page_id, "
    f"{sqlgen.sanitize_step_fns()[4][1](sqlgen.sanitize_step_fns()[3][1]('html'))} AS text_out FROM pages"
)


@register("sanitize_html", _HTML_SQL)
def sanitize_html(spark, sf):
    """V6 then V7 on raw web pages: scripts removed with content, tags stripped."""
    p = tables.table(spark, sf, "pages").select("page_id", "html")
    from ..operators.sanitize import steps
    (_l6, [(rx6, rep6)]), (_l7, [(rx7, rep7)]) = steps()[3], steps()[4]
    return p.select("page_id", F.regexp_replace(F.regexp_replace("html", rx6, rep6), rx7, rep7).alias("text_out"))


_ACTIONS_SQL = f"""SELECT CAST(id AS BIGINT) AS doc_id, t7 AS text_out, array_to_string(actions, ',') AS actions,
       true AS is_valid
FROM {sqlgen.sanitize_chain_sql(DIRTY, 'doc_id', 'text')}"""


@register("sanitize_actions", _ACTIONS_SQL)
def sanitize_actions(spark, sf):
    """Full ordered chain with the action list."""
    d = sanitize(dirty.dirty_documents(spark, sf), "text")
    return d.select("doc_id", F.col("text").alias("text_out"), F.array_join("actions", ",").alias("actions"),
                    "is_valid")


_REPORT_SQL = f"""SELECT action, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(bytes_removed) AS BIGINT) AS bytes_removed
FROM (SELECT unnest(actions) AS action, octet_length(encode(t0)) - octet_length(encode(t7)) AS bytes_removed
      FROM {sqlgen.sanitize_chain_sql(DIRTY, 'doc_id', 'text')})
GROUP BY action"""


@register("sanitize_report", _REPORT_SQL)
def sanitize_report(spark, sf):
    """Documents per sanitiser action and bytes removed by the whole chain."""
    d = dirty.dirty_documents(spark, sf).withColumn("raw_bytes", F.octet_length("text"))
    s = sanitize(d, "text")
    e = explode_rows(s, [(F.col("raw_bytes") - F.octet_length("text")).alias("bytes_removed")], "actions", "action")
    return e.groupBy("action").agg(F.count("*").cast("bigint").alias("n_docs"),
                                   F.sum("bytes_removed").cast("bigint").alias("bytes_removed"))


# Oversize view: whole documents, with long ones repeated past the byte cap
# and short Spanish ones preceded by a line-count bomb.
_OVERSIZE_SQL_SRC = ("SELECT doc_id, CASE WHEN n_chars > 20000 THEN repeat(text, 60) "
                     "WHEN lang = 'es' AND n_chars < 400 THEN repeat(chr(10), 50000) || text ELSE text END AS text "
                     "FROM documents")
_REJECT_SQL = f"""SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CASE WHEN octet_length(encode(text)) > {catalog.MAX_INPUT_BYTES} THEN {lit(catalog.ERROR_TOO_LARGE)}
            WHEN length(text) - length(replace(text, chr(10), '')) >= {catalog.MAX_LINE_COUNT}
              THEN {lit(catalog.ERROR_TOO_MANY_LINES)} END AS error,
       CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes
FROM ({_OVERSIZE_SQL_SRC})"""


@register("reject_oversize", _REJECT_SQL)
def reject_oversize(spark, sf):
    """V1/V2: byte-size and line-count rejection (rejected rows kept, with error)."""
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    text = (F.when(F.col("n_chars") > 20000, F.repeat("text", 60))
            .when((F.col("lang") == "es") & (F.col("n_chars") < 400),
                  F.concat(F.repeat(F.lit("\n"), 50000), F.col("text")))
            .otherwise(F.col("text")))
    d = d.select("doc_id", text.alias("text"))
    return d.select("doc_id", rejection(F.col("text")).alias("error"),
                    F.octet_length("text").cast("bigint").alias("n_bytes"))


# NFC: documents with every 'é' decomposed to 'e' + U+0301; NFC must restore them.
_NFC_SQL = ("SELECT CAST(doc_id AS BIGINT) AS doc_id, nfc_normalize(replace(text, chr(233), 'e' || chr(769))) AS text_out "
            "FROM documents")


@register("nfc_normalize", _NFC_SQL)
def nfc_normalize(spark, sf):
    """NFC, only for rows that can change."""
    d = tables.table(spark, sf, "documents").select(
        "doc_id", F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")).alias("text"))
    return d.select("doc_id", normalize.nfc(F.col("text")).alias("text_out"))
