"""Sanitisation input view over ``documents``.

The corpus contains no control characters, invisible code points, base64
blocks, markdown images or whitespace runs, so the sanitiser checks read a
view that wraps every *whole* document text with such material, chosen by
the row's language.  Built identically in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from .tables import table

# (lang, prefix pieces, suffix pieces); a piece is a literal or ("sha", n)
# = the text's SHA-256 hex repeated n times (a base64-alphabet block).
VARIANTS = {
    "en": (["<script type='x'>alert(1)</script>\x01"], [" <b>bold</b> \x7f end"]),
    "fr": (["\u200b"], [" ![logo](https://img.example/x.png) ![local](img/y.png) \u00ad"]),
    "de": ([], [" ", ("sha", 4), " ", "\n\n\n\n\n", "tail", " " * 12, "end"]),
    "es": ([], []),
}


def _spark_piece(p):
    if isinstance(p, str):
        return F.lit(p)
    return F.repeat(F.sha2(F.col("text"), 256), p[1])


def _sql_piece(p):
    if isinstance(p, str):
        out = []
        for ch in p:
            out.append(f"chr({ord(ch)})" if ord(ch) < 32 or ord(ch) in (127, 173, 0x200b) else
                       "'" + ch.replace("'", "''") + "'")
        return " || ".join(out) if out else "''"
    return f"repeat(sha256(text), {p[1]})"


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    expr = None
    for lang, (pre, suf) in VARIANTS.items():
        body = F.concat(*[_spark_piece(p) for p in pre], F.col("text"), *[_spark_piece(p) for p in suf])
        expr = F.when(F.col("lang") == lang, body) if expr is None else expr.when(F.col("lang") == lang, body)
    return d.select("doc_id", expr.otherwise(F.col("text")).alias("text"))


def dirty_documents_sql() -> str:
    arms = []
    for lang, (pre, suf) in VARIANTS.items():
        parts = [_sql_piece(p) for p in pre] + ["text"] + [_sql_piece(p) for p in suf]
        arms.append(f"WHEN lang = '{lang}' THEN {' || '.join(parts)}")
    return f"SELECT doc_id, CASE {' '.join(arms)} ELSE text END AS text FROM documents"
