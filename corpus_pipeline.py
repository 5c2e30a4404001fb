"""Corpus preparation as a chain of stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet under ``spark.checkpoint.dir`` and reads it back as the
next stage's ``docs``.  All stages but the last return the columns of
``documents``.  Nulls, empty texts, repeated rows, empty tables and further
columns are treated as the stage's operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontam, langid, line_dedup, packing, simhash
from veilspark.llm.common import Scratch, fresh, held_out, read

#: Cosine below which a text resembles no language's profile: four deviations
#: of what chance gives (1 / sqrt(dimensions)).
MIN_LANGUAGE_SCORE = 4 / langid.DIM ** 0.5
#: Texts of fewer letters have too few trigrams for that; their letters decide.
SHORT_LETTERS = 32


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no known language, go.  A text of
    fewer than ``SHORT_LETTERS`` letters stays, whatever its cosine, if at least
    half of them are letters that the learning rows use."""
    lang, score = fresh(docs, "_lang_pred", "_lang_score")
    learning = docs.where(~held_out())
    profiles = langid.learn_profiles(learning)
    n, known = langid.known_letters(F.col("text"), langid.learn_letters(learning))
    found = langid.identify(docs, profiles, lang_out=lang, score_out=score)
    like = F.when(F.col(lang) == langid.UNKNOWN, False).when(F.col(score) >= MIN_LANGUAGE_SCORE, True).otherwise((n < SHORT_LETTERS) & (2 * known >= n))
    return found.where(like).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; a document that
    had nothing else goes too.  ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs.withColumnRenamed("n_lines", "_own_n_lines").withColumnRenamed("n_removed", "_own_n_removed"))
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))) \
        .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .drop("n_lines", "n_removed")
    return kept.withColumnRenamed("_own_n_lines", "n_lines").withColumnRenamed("_own_n_removed", "n_removed").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the least id."""
    return simhash.near_dedup(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    leaks, = fresh(docs, "_leaks")
    found = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"), out=leaks)
    return found.where(F.size(leaks) == 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: the corpus as it is fed to training."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Language ID, SimHash and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    out = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = scratch.cut(stage(spark, out, sf_dir))
    return out
