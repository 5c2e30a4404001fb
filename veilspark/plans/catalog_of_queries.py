"""Imports every plan module so its queries register, and exposes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_admission, q_detect, q_redact, q_reports, q_sanitize  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES


def queries():
    return QUERIES


def oracle():
    return ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import q_redact
    return q_redact.redact_documents(spark, sf_dir)
