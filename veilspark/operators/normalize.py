"""NFC normalisation.

Spark has no NFC function.  Text made only of code points below U+0300 is in
NFC already, so only rows with something beyond go to an Arrow UDF; all others
send it a null.  The UDF is deterministic, so filters on other columns pass
below it down to the scan.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Anything at or above U+0300 (combining marks and beyond) may need composition.
_MAY_CHANGE = "[^\\x{0}-\\x{2FF}]"


def _compose(s: pa.Array) -> pa.Array:
    if s.null_count == len(s):
        return s
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


def composed(text: Column) -> Column:
    """NFC of a text that may not be in it, null for all others."""
    beyond = (F.octet_length(text) != F.length(text)) & text.rlike(_MAY_CHANGE)  # lengths first: most rows are ASCII
    return F.arrow_udf(_compose, T.StringType())(F.when(beyond, text))


def nfc(text: Column) -> Column:
    return F.coalesce(composed(text), text)


def normalize(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, nfc(F.col(text_col)))
