"""Helpers shared by the operators: table access, written intermediate tables, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Fixed values of the contracts: a word is a run of anything but space and the controls 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows that no model may learn labels from; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


class Scratch:
    """Tables written under ``spark.checkpoint.dir``, to cut lineage where a
    lost executor would otherwise force long recomputation.  Every object
    owns a folder of its own, so concurrent runs do not meet."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        self._n = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *upto: int) -> None:
        """Delete tables by number; for loops whose older rounds nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for n in upto:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}")
            p.getFileSystem(conf).delete(p, True)

    @property
    def last(self) -> int:
        return self._n


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Cap the rows of an Arrow batch, so that a batch of long texts stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet of such files: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
