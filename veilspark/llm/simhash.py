"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprint: A-Z in lower case, words, word shingles (repeats included) joined
by a space; a text with fewer words is one shingle.  A bit is set if it is set
in over half of the shingles' XXH64 values (seed 42).

Search: the 64 bits fall into segments.  There is a table of the distinct
fingerprints by the value of each segment.  Of two fingerprints at most
``max_bits`` bits apart, some segment differs in at most ``max_bits /
segments`` bits: each fingerprint looks up, per segment, the values of the
Hamming ball of that radius around its own, and the whole distance to what it
finds is checked.  Links of one segment value that many fingerprints share
come from a join that AQE splits.  Components of the links are the groups.

Two segments of 32 bits (66 values looked up at 2 bits) keep what is found
near what is linked: a value is shared by chance by one in 2^32, where 16-bit
segments would be shared by n / 65,536 fingerprints.

Defined results: null, empty and wordless texts have fingerprint zero and link
like any other.  A null id never becomes a component id unless the whole
component has none.  Repeated rows come back as often as they came.  An empty
table gives an empty result.  Other columns of the input are not used.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches
from .graph import components

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = 255  # rows of bits that a byte can count


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the 64-bit values."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // _ROWS * _ROWS
    count = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        count += bits[:whole].reshape(-1, _ROWS, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(bits), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    # bytes.split() parts at the space and 0x09-0x0D and at nothing else.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(line, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))  # one past the space after each word
    starts = [0, *ends[:-shingle]]
    bits = np.zeros(64, np.int64)
    if len(starts) <= 1 << 16:
        return _majority(np.array([h(line[a:b - 1], SEED) for a, b in zip(starts, ends[shingle - 1:], strict=True)], np.uint64))
    # very long texts: count in blocks
    for i in range(0, len(starts), 1 << 16):
        v = np.array([h(line[a:b - 1], SEED) for a, b in zip(starts[i:i + (1 << 16)], ends[shingle - 1 + i:], strict=False)], np.uint64)
        bits += np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long."""
    @F.pandas_udf("long")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(x, shingle) for x in s], np.uint64).view(np.int64))

    return f(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(width: int, radius: int) -> list[int]:
    """The masks of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _each(masks: Column, segment: Column, here: Column) -> Column:
    return F.transform(masks, lambda m: F.struct(segment.alias("segment"), F.col("fp").bitwiseXOR(m).bitwiseAND(here).alias("value")))


def fingerprint_links(prints: DataFrame, max_bits: int = 2, segments: int = 2) -> DataFrame:
    """``prints(fp)``, distinct -> ``(a, b)``: all pairs at most ``max_bits`` apart, ``a < b`` as signed longs."""
    filed, looked_up, at = [], [], 0
    for s in range(segments):
        width = (64 - at) // (segments - s)
        here = F.lit(_signed(((1 << width) - 1) << at))
        filed.append(F.struct(F.lit(s).alias("segment"), F.col("fp").bitwiseAND(here).alias("value")))
        masks = F.array(*[F.lit(_signed(m << at)).cast("long") for m in ball(width, max_bits // segments)])
        looked_up.append(_each(masks, F.lit(s), here))
        at += width
    table = prints.select(F.col("fp").alias("b"), F.inline(F.array(*filed)))
    probes = prints.select(F.col("fp").alias("a"), F.inline(F.concat(*looked_up)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probes.hint("merge").join(table, ["segment", "value"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
           max_bits: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: ``(id_col, _text_hash, fp, root, component_id)``;
    ``root`` is the component's least fingerprint."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "simhash")
    small_batches(spark)
    rows = scratch.cut(df.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("_text_hash"),
                                 fingerprint(F.col(text_col), shingle).alias("fp")))
    prints = scratch.cut(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    links = scratch.cut(fingerprint_links(prints.select("fp"), max_bits))
    root = components(links, scratch).select(F.col("node").alias("fp"), "root")
    named = prints.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = scratch.cut(named.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(label, "fp").select(id_col, "_text_hash", "fp", "root", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 2) -> DataFrame:
    """``df`` with one row of each component: that of the least id (nulls last),
    of the least text hash among rows that share it."""
    scratch = Scratch(df.sparkSession, "simhash")
    found = groups(df, id_col, text_col, shingle, max_bits, scratch)
    first = found.groupBy("root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("i"), F.col("_text_hash").alias("h"))).alias("m"))
    th, keep_id, keep_hash = fresh(df, "_text_hash", "_keep_id", "_keep_hash")
    keep = scratch.cut(first.select(F.col("m.i").alias(keep_id), F.col("m.h").alias(keep_hash)))
    hashed = df.withColumn(th, F.xxhash64(F.col(text_col)))
    kept = hashed.join(keep, F.col(th).eqNullSafe(F.col(keep_hash)) & F.col(id_col).eqNullSafe(F.col(keep_id)), "left_semi")
    return kept.dropDuplicates([id_col, th]).select(*df.columns)
