"""Ranked lexical search: the best documents for every item, by norm buckets.

Terms are weighted by rarity, a document's term by its frequency against the
document's length; a score is the sum of their products over the item's terms.
A document is the vector of its terms' products ("impacts"), an item the set
of its terms, so a score is an inner product.

The impact vectors are sorted by length, longest first, over all tasks, and
each task cuts its stretch into buckets.  An item whose tenth-best score so
far exceeds the item's length times that of a bucket's longest vector is done
with the task (Cauchy-Schwarz).  Inside a bucket the greatest value of each
coordinate bounds what the item's terms can add: documents that hold none of
the terms that matter are never touched, and of the others, those stay whose
sum over these terms and bound on the rest (by coordinates, and by
Cauchy-Schwarz on what is left of both vectors) reach the tenth-best score.
Survivors are rescored in 64-bit integers.  A first look at the globally
longest bucket gives every task scores to start from.

Items are worked off in blocks of bounded size, each against all documents;
only a block's terms and its items' sizes are held by the driver and the tasks.

Defined results: null texts, and texts without a term, are in no ranking and
do not count as documents; an item without a term, or with none that a
document holds, has no rows.  Rows of one item id are one item, with the terms
of all its texts.  Repeated documents are ranked each; equal scores stand by
ascending id, null ids last.  Empty tables give an empty result.  Other
columns of the inputs are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, small_batches

TOP = 10
#: Distinct terms that the items of one block may have together, about.
BLOCK_TERMS = 500_000
BUCKET = 2048
_SLACK = 1 + 1e-9  # bounds are in doubles
# Fixed values of the contract: a term is a run of ASCII letters and digits and of anything beyond ASCII.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds for each unit of its weight; ``n`` is its document's number of terms."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Vocabulary:
    """The terms of a block's items, and each item's terms by number."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.number: dict[bytes, int] = {}
        self.items = [(i, np.array(sorted(self.number.setdefault(t, len(self.number)) for t in terms), np.int64)) for i, terms in items]


_VECTORS = T.StructType([T.StructField(n, t) for n, t in (
    ("n", T.LongType()), ("term", T.BinaryType()), ("tf", T.BinaryType()))])


def _doc_vectors(docs: DataFrame, sent, id_type: T.DataType) -> DataFrame:
    """``(doc, n, term, tf)`` of documents with a term: numbers of the block's terms and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        for batch in batches:
            keep, size, term, tf = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    t, c = np.unique(np.array([number[w] for w in words if w in number], np.int32), return_counts=True)
                    keep.append(k)
                    size.append(len(words))
                    term.append(t.tobytes())
                    tf.append(c.astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()),
                                   pa.array(term, pa.binary()), pa.array(tf, pa.binary())], names=["doc", *_VECTORS.names])

    small_batches(docs.sparkSession, 1024)
    return docs.mapInArrow(run, T.StructType([T.StructField("doc", id_type), *_VECTORS]))


class Bucket:
    """Impact vectors in descending length, as postings by term."""

    def __init__(self, terms: list[np.ndarray], values: list[np.ndarray], norms: np.ndarray):
        self.norms = norms
        sizes = np.array([len(t) for t in terms])
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.row = np.repeat(np.arange(len(terms)), sizes)[order]
        self.value = np.concatenate(values)[order]
        self.term, first = np.unique(term[order], return_index=True)
        self.bound = np.append(first, len(term))
        self.top = np.maximum.reduceat(self.value, first) if len(first) else np.zeros(0, np.int64)

    def survivors(self, item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and their exact scores, that may reach ``least`` (1 or more) for the item's terms."""
        at = np.flatnonzero(np.isin(self.term, item, assume_unique=True))
        at = at[np.argsort(-self.top[at], kind="stable")]
        # the terms that matter: without one of them the others' greatest values stay below
        rest = np.append(np.cumsum(self.top[at][::-1])[::-1], 0)
        lead = int(np.searchsorted(-rest, -least, side="right"))
        if not lead:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = [slice(self.bound[k], self.bound[k + 1]) for k in at]
        rows = np.concatenate([self.row[c] for c in cut[:lead]])
        vals = np.concatenate([self.value[c] for c in cut[:lead]]).astype(np.float64)
        part = np.bincount(rows, vals, len(self.norms))
        square = np.bincount(rows, vals * vals, len(self.norms))
        seen = np.flatnonzero(part)
        left = np.sqrt(np.maximum(self.norms[seen] ** 2 * _SLACK - square[seen], 0) * (len(at) - lead))
        stay = seen[(part[seen] + np.minimum(left, rest[lead])) * _SLACK >= least]
        # exactly, over all of the item's terms
        place = np.full(len(self.norms), -1)
        place[stay] = np.arange(len(stay))
        score = np.zeros(len(stay), np.int64)
        for c in cut:
            p = place[self.row[c]]
            score[p[p >= 0]] += self.value[c][p >= 0]  # a term's rows are distinct
        return stay, score


def search(buckets: Iterator[tuple[list, Bucket]], items: list[tuple[int, np.ndarray]], start: dict[int, int], top: int = TOP) -> dict[int, list]:
    """``{item: [(-score, id is null, id), ..]}``: at most ``top`` of the documents
    given, whose score is above 0 and not below ``start[item]``."""
    best: dict[int, list] = {}
    active = {i: t for i, t in items if len(t)}
    floor = {i: start.get(i, 1) for i in active}
    for ids, bucket in buckets:
        for i in list(active):
            if math.sqrt(len(active[i])) * bucket.norms[0] * _SLACK < floor[i]:
                del active[i]  # nor do the shorter vectors that follow
                continue
            rows, score = bucket.survivors(active[i], floor[i])
            ok = score >= max(floor[i], 1)
            if ok.any():
                new = [(-int(s), ids[r] is None, ids[r]) for r, s in zip(rows[ok], score[ok], strict=True)]
                best[i] = sorted(best.get(i, []) + new, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:top]
                if len(best[i]) == top:
                    floor[i] = max(floor[i], -best[i][-1][0])
        if not active:
            break
    return best


def _buckets(batches: Iterator[pa.RecordBatch], w: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[list, Bucket]]:
    """Rows ``(doc, n, term, tf)`` in order -> buckets."""
    ids: list = []
    terms: list[np.ndarray] = []
    values: list[np.ndarray] = []

    def made():
        norms = np.array([math.sqrt(float(v.astype(np.float64) @ v)) for v in values])
        return list(ids), Bucket(terms, values, norms)

    for batch in batches:
        for doc, n, term, tf in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            t, v = _vector(n, term, tf, w, n_docs, n_terms)
            ids.append(doc)
            terms.append(t)
            values.append(v)
            if len(ids) == BUCKET:
                yield made()
                ids, terms, values = [], [], []
    if ids:
        yield made()


def _vector(n: int, term: bytes, tf: bytes, w: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    t, c = np.frombuffer(term, np.int32), np.frombuffer(tf, np.int32).astype(np.int64)
    v = w[t] * impacts(np.int64(n), c, n_docs, n_terms)
    return t[v > 0], v[v > 0]


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_col, rank, id_col, score)``: each item's ``top`` documents of highest score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical-search")
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))],
                                  names=["item", "terms"])

    schema = T.StructType([T.StructField("item", item_type), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    parted = items.select(F.col(item_col), F.col(item_text_col)).mapInArrow(split, schema)
    merged = parted.select("item", F.explode("terms").alias("t")).groupBy("item").agg(F.collect_set("t").alias("terms"))
    merged = scratch.cut(merged)
    n_blocks = -(-(merged.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    found = spark.createDataFrame([], T.StructType([T.StructField("item", item_type), T.StructField("rank", T.IntegerType()),
                                                    T.StructField("doc", id_type), T.StructField("score", T.LongType())]))
    for block in range(n_blocks):
        mine = _rank_block(texts, merged.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block), scratch, id_type, top)
        found = mine if n_blocks == 1 else found.unionByName(mine)
    return found.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _rank_block(texts: DataFrame, items: DataFrame, scratch: Scratch, id_type: T.DataType, top: int) -> DataFrame:
    spark, ids = texts.sparkSession, to_arrow_type(id_type)
    out_schema = T.StructType([T.StructField("item_no", T.LongType()), T.StructField("doc", id_type), T.StructField("score", T.LongType())])
    rows = items.select("item", "terms").collect()  # bounded by the block's number of terms
    vocabulary = _Vocabulary([(k, [bytes(t) for t in r["terms"]]) for k, r in enumerate(rows)])
    sent = spark.sparkContext.broadcast(vocabulary)
    table = scratch.cut(_doc_vectors(texts, sent, id_type))
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    item_ids = [r["item"] for r in rows]
    names = spark.createDataFrame([(k, i) for k, i in enumerate(item_ids)], T.StructType([out_schema[0], T.StructField("item", items.schema["item"].dataType)]))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(sent.value.number), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                count[np.frombuffer(t, np.int32)] += 1
        t = np.flatnonzero(count)
        yield pa.record_batch([pa.array(t), pa.array(count[t])], names=["t", "n"])

    df = np.zeros(len(vocabulary.number), np.int64)
    for r in table.select("term").mapInArrow(held, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # at most the block's terms
        df[r["t"]] = r["n"]
    w = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = [_vector(*r, w, n_docs, n_terms)[1].astype(np.float64) for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield batch.append_column("norm", pa.array([math.sqrt(float(v @ v)) for v in vs], pa.float64()))

    with_norm = scratch.cut(table.mapInArrow(lengths, T.StructType([*table.schema, T.StructField("norm", T.DoubleType())])).where("norm > 0") \
        .withColumn("tie", F.rand(11)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search(_buckets(batches, w, n_docs, n_terms), sent.value.items, {}, top)
        full = [(i, -b[-1][0]) for i, b in best.items() if len(b) == top]
        yield pa.record_batch([pa.array([i for i, _ in full], pa.int64()), pa.array([s for _, s in full], pa.int64())], names=["item_no", "least"])

    longest = with_norm.orderBy(F.col("norm").desc(), "tie").limit(BUCKET).coalesce(1)
    start = {r["item_no"]: r["least"] for r in longest.select("doc", "n", "term", "tf").mapInArrow(first, "item_no long, least long").collect()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = search(_buckets(batches, w, n_docs, n_terms), sent.value.items, start, top)
        flat = [(i, doc, -s) for i, found in best.items() for s, _, doc in found]
        yield pa.record_batch([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], ids), pa.array([r[2] for r in flat], pa.int64())],
                              names=out_schema.names)

    # A task reads its stretch of the order straight from the shuffle: files would come in any order.
    ordered = with_norm.repartitionByRange(F.col("norm").desc(), "tie").sortWithinPartitions(F.col("norm").desc(), "tie")
    found = ordered.select("doc", "n", "term", "tf").mapInArrow(scan, out_schema)
    by = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    out = scratch.cut(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
                      .join(names, "item_no").select("item", "rank", "doc", "score"))
    sent.destroy()
    return out
