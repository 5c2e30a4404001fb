"""Byte-bounded shards by extendible hashing.

A row's key is hashed to 60 bits.  A bucket is the set of rows that share the
leading bits; a bucket over the byte limit splits on its next bit, the others
stay as they are.  The directory maps every value of the leading ``depth``
bits to its bucket, so a row finds its shard with one equi-join.

Byte sums come first: they are taken per directory slot with a map-side part,
and the splitting works on those sums.  The directory starts a few bits deeper
than an even spread needs; where slots are still too large, only their rows go
on to deeper bits.  Rows that share all bits (one key with a large share of all
rows) cannot be parted by hashing: such a bucket gets numbered overflow pages,
each filled up to the limit in an order of written parts, never in one task.

Defined results: a null text has 0 bytes; a null key is a key of its own; a row
larger than the limit has a shard to itself (``oversized``).  Repeated rows are
placed one by one.  An empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh

BITS = 60
_SPARE = 5  # bits of the directory beyond those of an even spread


def key_hash(key: Column) -> Column:
    """60 leading bits of the MD5 of the key's text; null hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: int | str) -> str:
    return f"shiftright({h}, {BITS} - ({depth}))"


def directory(sums: DataFrame, depth: int, limit: int, above: int = 0) -> DataFrame:
    """``sums(slot, bytes, n)`` at ``depth`` bits -> ``(slot, local_depth, fits)``.

    A slot's bucket is its shortest prefix, longer than ``above`` bits only if
    every shorter one is over the limit, whose rows fit the limit - or whose
    only row does not."""
    levels = sums.select("slot", "bytes", "n", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("d")) \
        .withColumn("p", F.expr(f"shiftright(slot, cast({depth} - d as int))"))
    sizes = levels.groupBy("d", "p").agg(F.sum("bytes").alias("size"), F.sum("n").alias("rows"))
    ok = levels.join(sizes.where((F.col("size") <= limit) | (F.col("rows") == 1)), ["d", "p"]).groupBy("slot").agg(F.min("d").alias("local_depth"))
    return sums.select("slot").join(ok, "slot", "left").select(
        "slot", F.coalesce("local_depth", F.lit(depth)).alias("local_depth"), F.col("local_depth").isNotNull().alias("fits"))


def _overflow(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Pages for rows that share all bits: bytes are summed along (written part, position).

    The part number is written with the rows, so it stays what it is on a retry;
    sums per part are few, and the running sums stay inside one part."""
    parts = scratch.cut(rows.repartition(F.col("h"), F.floor(F.rand(7) * F.greatest(F.ceil(F.col("size") / (8 * limit)), F.lit(1))))
                        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    # A page never mixes parts, so pages are numbered by part and by filling within it.
    inside = Window.partitionBy("h", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Two neighbours in an over-full window are parted by cutting at half the limit: rows up to half of it
    # fill pages by running sum, larger ones have a page of their own.
    half = max(limit // 2, 1)
    small = F.when(F.col("n_bytes") <= half, F.col("n_bytes")).otherwise(0)
    numbered = parts.withColumn("upto", F.sum(small).over(inside)).withColumn(
        "page", F.when(F.col("n_bytes") <= half, F.greatest(F.floor((F.col("upto") - 1) / half), F.lit(0))))
    return numbered.withColumn("tail", F.when(F.col("page").isNull(), F.format_string("%d.%d", "part", "at"))
                               .otherwise(F.format_string("%d-%d", "part", "page")))


def assign_shards(df: DataFrame, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text",
                  scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``(key_col, n_bytes, shard, local_depth, oversized)``.

    ``shard`` is the bucket's bits as text (``-`` for the whole table), with a
    page for overflow rows; no shard holds more than ``limit_bytes``, oversized
    single rows apart."""
    scratch = scratch or Scratch(df.sparkSession, "sharding")
    key, = fresh(df, "_key")
    out = _place(df.select(F.col(key_col).alias(key), *_hash_and_bytes(key_col, text_col)), limit_bytes, key, scratch)
    return out.select(F.col(key).alias(key_col), "n_bytes", "shard", F.col("local_depth").cast("int").alias("local_depth"),
                      (F.col("n_bytes") > limit_bytes).alias("oversized"))


def _hash_and_bytes(key_col: str, text_col: str) -> list[Column]:
    return [key_hash(F.col(key_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")]


def _place(rows: DataFrame, limit_bytes: int, key: str, scratch: Scratch) -> DataFrame:
    """Each of ``rows(key, h, n_bytes)`` once, with ``shard`` and ``local_depth``."""
    rows = scratch.cut(rows)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit_bytes))) + _SPARE)
    done, open_, above = [], rows, 0
    while True:
        slots = open_.withColumn("slot", F.expr(_prefix("h", depth)))
        sums = scratch.cut(slots.groupBy("slot").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")))
        index = scratch.cut(directory(sums, depth, limit_bytes, above).join(sums.select("slot", "bytes"), "slot"))
        # The directory grows with the table, so it is dealt out like the rows.
        placed = slots.join(index.withColumnRenamed("bytes", "size").hint("merge"), "slot")
        done.append(placed.where("fits").select(
            key, "n_bytes", "local_depth", F.expr(
                f"if(local_depth = 0, '-', right(lpad(bin({_prefix('h', 'cast(local_depth as int)')}), {BITS}, '0'), local_depth))").alias("shard")))
        if index.where("not fits").isEmpty():
            break
        open_ = scratch.cut(placed.where("not fits").select(key, "h", "n_bytes", "size"))
        if depth == BITS:
            done.append(_overflow(open_, limit_bytes, scratch).select(
                key, "n_bytes", F.lit(BITS).alias("local_depth"),
                F.concat(F.expr(f"lpad(bin(h), {BITS}, '0')"), F.lit("/"), F.col("tail")).alias("shard")))
            break
        above, depth = depth + 1, min(BITS, depth + 12)
        open_ = open_.select(key, "h", "n_bytes")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def write_shards(df: DataFrame, path: str, limit_bytes: int, key_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each row of ``df`` once, as one folder per shard (``shard=...``, or ``_shard=...`` where ``df`` has such a column).

    Rows meet their shards by a row number that is written with them, so keys may repeat."""
    scratch = Scratch(df.sparkSession, "sharding")
    row, shard = fresh(df, "_row", "shard")
    rows = scratch.cut(df.withColumn(row, F.monotonically_increasing_id()))
    placed = _place(rows.select(row, *_hash_and_bytes(key_col, text_col)), limit_bytes, row, scratch)
    rows.join(placed.select(row, F.col("shard").alias(shard)), row).drop(row) \
        .repartition(shard).write.partitionBy(shard).parquet(path)
