"""Readers for the corpus tables.

Every reader selects only the columns its operators use, so the Parquet scan
prunes to them (``ReadSchema`` in the plan) and filters push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Parts for work that is much larger than its rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt out by their key, for work that is much larger than they
    are: a file is read by as many tasks as it has row groups, and AQE sizes
    partitions by bytes.  A fixed number of partitions is not merged again, and a
    join or a group by the same key needs no further shuffle."""
    return df.repartition(tasks(df.sparkSession), key)


def documents(spark: SparkSession, sf_dir: str, context: str | None = None) -> DataFrame:
    """``(doc_id, text, context)``; the corpus carries no context column, so
    one is attached (default ``general``)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(context or catalog.DEFAULT_CONTEXT).alias("context"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit(catalog.DEFAULT_CONTEXT).alias("context"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")


REQUEST_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("context", T.StringType(), True),
])


CORRUPT = "_corrupt_record"


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Requests ``{doc_id, text, context}`` from JSON lines / Parquet with an
    explicit schema (no inference).  A JSON line that cannot be read stays,
    whole, in ``_corrupt_record``."""
    if fmt != "json":
        return spark.read.schema(REQUEST_SCHEMA).format(fmt).load(path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in REQUEST_SCHEMA] + [T.StructField(CORRUPT, T.StringType(), True)])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file (``wholetext``), id = hash of the path."""
    df = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return df.select(
        F.xxhash64("path").alias("doc_id"), F.col("value").alias("text"),
        F.lit(catalog.DEFAULT_CONTEXT).alias("context"),
    )


def tag_requests(df: DataFrame, text_col: str = "text", context_col: str = "context",
                 max_chars: int | None = catalog.MAX_REQUEST_CHARS) -> DataFrame:
    """Adds ``reject_reason``: null, or why the request schema refuses the row:
    a line that is no JSON object of the schema, no text, a text longer than
    ``max_chars`` (None: no limit), a context outside the allowed set."""
    reason = F.when(F.col(text_col).isNull(), F.lit("missing_text"))
    if CORRUPT in df.columns:
        reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed_record")).when(F.col(text_col).isNull(), F.lit("missing_text"))
    if max_chars is not None:
        reason = reason.when(F.length(text_col) > max_chars, F.lit("text_too_long"))
    known = F.coalesce(F.col(context_col), F.lit(catalog.DEFAULT_CONTEXT)).isin(list(catalog.CONTEXT_ENTITIES))
    return df.withColumn("reject_reason", reason.when(~known, F.lit("unknown_context")))


def split_requests(df: DataFrame, text_col: str = "text", context_col: str = "context",
                   max_chars: int | None = catalog.MAX_REQUEST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by ``tag_requests``: nothing is dropped, the
    quarantine carries the reason and, for malformed lines, the record."""
    tagged = tag_requests(df, text_col, context_col, max_chars)
    accepted = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted.drop(CORRUPT), tagged.filter(F.col("reject_reason").isNotNull())
