"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its trigrams of character shapes (case, digit, white space,
single punctuation marks), its hashed character pairs, and pairs of word
novelty (new, seen before, same as the last word).  Log counts weighted by
inverse document frequency, each of the three blocks at unit length, are
projected on the leading singular vectors of a bounded sample of labelled
rows.  That sample's vectors go to every task; each block of texts is
multiplied with all of them, and the ``NEIGHBOURS`` with the largest cosine
vote for their label, weighted by a power of the cosine.

The sample holds at most ``rows_per_label`` rows of each label, taken by a hash
of the id; so both labels weigh the same.

Defined results: null and empty texts have no terms and score 0.  Rows without
a label, or labelled rows without a document, are not learnt from; with
nothing to learn from every score is 0.  Repeated rows are scored each; an
empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

SHAPES, PAIRS, NOVELTY = 512, 256, 9
DIM = 64
NEIGHBOURS = 25
POWER = 8
_KINDS = 40
_kind: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """Code point -> shape: letter cases, digits, white space, 32 punctuation marks, the rest."""
    global _kind
    if _kind is None:
        by = {"Lu": 1, "Lt": 1, "Ll": 2, "Lo": 3, "Lm": 3, "Nd": 4, "Zs": 5}
        t = np.fromiter((by.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)), np.uint8, 0x110000)
        t[[9, 11, 12, 13]] = 5
        t[10] = 6
        marks = [c for c in range(0x21, 0x7F) if unicodedata.category(chr(c))[0] in "PS"]
        t[marks] = 7 + np.arange(len(marks))
        _kind = t
    return _kind


def _mix(x: np.ndarray, size: int) -> np.ndarray:
    """Hash to ``size`` (a power of two) buckets by multiplication."""
    return (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(size)


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the three blocks of terms in a whole text."""
    out = np.zeros(SHAPES + PAIRS + NOVELTY, np.float32)
    if not text:
        return out
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _kind_table()[np.concatenate([[10], cps, [10]]).astype(np.uint32)].astype(np.uint32)
    tri = (k[:-2] * _KINDS + k[1:-1]) * _KINDS + k[2:]
    out[:SHAPES] = np.bincount(_mix(tri, SHAPES).astype(np.int64), minlength=SHAPES)
    out[SHAPES:SHAPES + PAIRS] = np.bincount(_mix((cps[:-1].astype(np.uint64) << np.uint64(21)) | cps[1:], PAIRS).astype(np.int64), minlength=PAIRS)
    words = text.split()
    seen: set[str] = set()
    last, state = None, 0
    pairs = [0] * NOVELTY
    for w in words:
        now = 2 if w == last else 1 if w in seen else 0
        seen.add(w)
        pairs[3 * state + now] += 1
        last, state = w, now
    out[SHAPES + PAIRS:] = pairs
    return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    m = np.log1p(counts) * idf
    for a, b in ((0, SHAPES), (SHAPES, SHAPES + PAIRS), (SHAPES + PAIRS, m.shape[1])):
        n = np.linalg.norm(m[:, a:b], axis=1, keepdims=True)
        m[:, a:b] = np.divide(m[:, a:b], n, out=np.zeros_like(m[:, a:b]), where=n > 0)
    return m


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 1e-9)


class Neighbours:
    """The labelled sample in the latent space."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dim: int = DIM):
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        m = _weigh(counts, self.idf)
        # Squared singular vectors of the terms: the sample is bounded, so is this matrix.
        values, vectors = np.linalg.eigh((m.T @ m).astype(np.float64))
        self.basis = vectors[:, np.argsort(values)[::-1][:dim]].astype(np.float32)
        self.points = _unit(m @ self.basis)
        self.labels = labels.astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        q = _unit(_weigh(counts, self.idf) @ self.basis)
        cos = q @ self.points.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(cos, -k, axis=1)[:, -k:]
        w = np.clip(np.take_along_axis(cos, near, axis=1), 0, 1) ** POWER
        total = w.sum(axis=1)
        return np.divide((w * self.labels[near]).sum(axis=1), total, out=np.zeros(len(q), np.float32), where=total > 0)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          rows_per_label: int = 2000) -> Neighbours | None:
    """Fit on at most ``rows_per_label`` rows of each of the labels 0 and 1."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    an_id, a_label = fresh(df, "_id", "_label")
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(an_id), F.col(label_col).alias(a_label))
    sizes = {r[a_label]: r["count"] for r in known.where(F.col(a_label).isin(0, 1)).groupBy(a_label).count().collect()}
    picked = None
    for label, n in sorted(sizes.items()):
        share = min(1.0, 1.3 * rows_per_label / n + 100 / n)  # a little more than needed; the limit makes it exact
        some = known.where((F.col(a_label) == label) & (F.pmod(F.xxhash64(F.col(an_id).cast("string")), F.lit(1 << 20)) <= share * (1 << 20)))
        some = some.orderBy(F.xxhash64(F.col(an_id).cast("string")), an_id).limit(rows_per_label)
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        return None
    # At most 2 * rows_per_label ids, and one row of each.
    rows = df.join(F.broadcast(picked), F.col(id_col) == F.col(an_id)).dropDuplicates([an_id]).select(
        h.alias("h"), F.col(a_label).cast("int").alias("label"), F.col(text_col).alias("text"))

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"h": pdf["h"], "label": pdf["label"], "counts": [term_counts(x).tolist() for x in pdf["text"]]})

    small_batches(df.sparkSession)
    got = sorted(rows.mapInPandas(count, "h long, label int, counts array<float>").collect())
    if not got:
        return None
    return Neighbours(np.array([r["counts"] for r in got], np.float32), np.array([r["label"] for r in got]))


def score_quality(df: DataFrame, model: Neighbours | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` plus the score (0 to 1, higher: label 1 likelier) of the whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for s in batches:
            got = np.zeros(len(s)) if m is None else m.score(np.stack([term_counts(x) for x in s])) if len(s) else np.zeros(0)
            yield pd.Series(got.astype(np.float64))

    small_batches(df.sparkSession)
    tmp, = fresh(df, "_score")
    keep = [c for c in df.columns if c != out]
    return df.withColumn(tmp, score(F.col(text_col))).select(*keep, F.col(tmp).alias(out))
