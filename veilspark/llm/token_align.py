"""Alignment of two tokenizers' tokens over the same bytes, in Arrow.

Every text is encoded by a byte-level BPE (A, with a space put before the
text) and by a sentencepiece model (B, which puts that space itself).  A batch
of documents is two Arrow list columns of ids: the lists are flattened with
their parent indices, the tokens' byte lengths are summed up per document, and
(document, end) keys of both sides meet in an Acero hash join.  Ends of both
sides close a group; every end of either side closes one stretch of bytes that
lies in exactly one A and one B token, hence one link.

Corpus counts: a task gathers documents into chunks of bounded bytes, counts
in each the documents of a linked id pair (``Table.group_by``), and writes one
row per chunk.  Spark adds up the partial counts by pair and hands each chunk
the totals of its own pairs, so what is shuffled are a chunk's distinct pairs
and not every document's.

Defined results: null and empty texts, and texts that one of the two
tokenizers does not give back byte for byte, have no tokens (all counts zero,
``groups`` empty).  Repeated rows are documents of their own.  An empty table
gives an empty result.  Other columns of the input are not used.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import Scratch, byte_chars, small_batches

#: Bytes of text that are encoded and joined at a time, and that share partial counts.
BATCH_BYTES = 2 << 20
CHUNK_BYTES = 8 << 20
#: Units whose ids a worker keeps for each tokenizer; beyond it the table starts anew.
KEPT_UNITS = 800_000
_SPACE = "\u2581"  # as sentencepiece writes a space
# The byte-level splitter, for characters up to Latin Extended-B, whose classes all tables agree on.
_LATIN = "\u024f"
_A_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_W = r"\p{White_Space}"
_A_LATIN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?!\P{{White_Space}})|{_W}+")
_B_UNITS = re.compile(r" *[^ ]+(?: +\Z)?| +")
_B_BITS = 32  # a pair is (A id << 32) + B id
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class _Units:
    """Ids, as bytes, of units met of late; ``encode`` gives those of a list of new ones."""

    def __init__(self, encode):
        self.encode, self.now, self.before = encode, {}, {}

    def of(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.now) > KEPT_UNITS // 2:
            self.now, self.before = {}, self.now
        now, before, new = self.now, self.before, []
        for u in set().union(*texts) - now.keys():
            if u in before:
                now[u] = before[u]
            else:
                new.append(u)
        for u, ids in zip(new, self.encode(new), strict=True):
            now[u] = array("i", ids).tobytes()
        get = now.__getitem__
        return [b"".join(map(get, t)) for t in texts]


class Encoders:
    """Both tokenizers, and the bytes of every id.

    Texts are cut into units that no token crosses, whose ids are the
    library's and are kept; a text for which that cannot be said goes to the
    library whole."""

    def __init__(self, a_spec: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.a = Tokenizer.from_str(a_spec)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        chars = byte_chars()
        byte_of = {c: b for b, c in chars.items()}
        named = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        # An added token that is no byte-level string has its own UTF-8 bytes.
        self.a_bytes = pa.array([bytes(map(byte_of.__getitem__, s)) if all(c in byte_of for c in s) else s.encode()
                                 for s in (named.get(i, "") for i in range(max(named, default=-1) + 1))], pa.large_binary())
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode()
                                 for i, p in enumerate(pieces)], pa.large_binary())
        self.decimal = pa.array(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))), pa.large_string())
        spec, model, table = json.loads(a_spec), self.a.model, str.maketrans(chars)
        split = spec.get("pre_tokenizer") or {}
        self.a_cut = (spec.get("normalizer") is None and split.get("type") == "ByteLevel"
                      and not split.get("add_prefix_space") and split.get("use_regex", True))
        self.a_units = _Units(lambda new: ([t.id for t in model.tokenize(u.encode().decode("latin-1").translate(table))] for u in new))
        # No piece goes on past a space that follows another character.
        self.b_cut = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        self.b_units = _Units(lambda new: self.b.encode([u[1:] for u in new], num_threads=1) if new else [])

    def _a_cut(self, text: str) -> list[str] | None:
        if not self.a_cut or max(text) > _LATIN:
            return None
        return (_A_ASCII if text.isascii() else _A_LATIN).findall(text)

    def _b_cut(self, text: str) -> list[str] | None:
        if not self.b_cut or _SPACE in text or self.b.normalize(text[1:]) != text.replace(" ", _SPACE):
            return None
        return _B_UNITS.findall(text)

    def _a_whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _b_whole(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        out = []
        texts = [" " + t for t in texts]
        for cut, units, whole in ((self._a_cut, self.a_units, self._a_whole), (self._b_cut, self.b_units, self._b_whole)):
            parts = list(map(cut, texts))
            done = iter(units.of([p for p in parts if p is not None]))
            rest = iter(whole([t for t, p in zip(texts, parts, strict=True) if p is None]))
            ids = [array("i", next(rest)).tobytes() if p is None else next(done) for p in parts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            out.append(pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32))))
        return tuple(out)


def _join(by: str | bytes) -> pa.Scalar:
    return pa.scalar(by, pa.large_string() if isinstance(by, str) else pa.large_binary())


def _lists(ends, values) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int64()), ends.cast(pa.int64())]), values)


def _keys(ids: pa.Array, lengths: pa.Array) -> pa.Array:
    """(document << 32) + end byte of each token: running sums, less what stood before the document."""
    run = pc.cumulative_sum(pc.take(lengths, pc.list_flatten(ids)).cast(pa.int64()))
    run = pa.concat_arrays([pa.array([0], pa.int64()), run])
    parent = pc.list_parent_indices(ids).cast(pa.int64())
    before = pc.take(pc.take(run, ids.offsets[:-1]), parent)
    return pc.add(pc.shift_left(parent, 32), pc.subtract(run.slice(1), before))


def align_batch(enc: Encoders, texts: list[str], text_groups: bool) -> tuple[dict[str, list], pa.Table]:
    """Non-empty texts -> columns (counts, ``groups``) and entries ``(doc, pair, n)``."""
    a, b = enc.encode(texts)
    want = pa.array([b" " + t.encode() for t in texts], pa.large_binary())
    rows = pa.array(np.arange(len(texts)))
    same = pc.and_(*(pc.equal(pc.binary_join(pa.LargeListArray.from_arrays(x.offsets, pc.take(y, pc.list_flatten(x))), _join(b"")), want)
                     for x, y in ((a, enc.a_bytes), (b, enc.b_bytes))))
    good, a, b = pc.filter(rows, same), pc.filter(a, same), pc.filter(b, same)
    out = {k: np.zeros(len(texts), np.int64) for k in _COUNTS}
    out["groups"] = [""] * len(texts)
    if not len(good):
        return out, pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    side_a = pa.table({"key": _keys(a, pc.binary_length(enc.a_bytes)), "a": pc.list_flatten(a)})
    side_b = pa.table({"key": _keys(b, pc.binary_length(enc.b_bytes)), "b": pc.list_flatten(b)})
    ends = side_a.join(side_b, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    key, ia, ib = (ends[c].combine_chunks() for c in ("key", "a", "b"))
    doc = pc.shift_right(key, 32)
    both = pc.and_(ia.is_valid(), ib.is_valid())
    place = good.to_numpy()
    d = doc.to_numpy()
    out["n_a"][place] = pc.list_value_length(a).to_numpy()
    out["n_b"][place] = pc.list_value_length(b).to_numpy()
    out["n_links"][place] = np.bincount(d, minlength=len(good))
    closed = np.bincount(d[both.to_numpy(zero_copy_only=False)], minlength=len(good))
    out["n_groups"][place] = closed
    # the group strings: ids of a side by group, groups by document
    sides = []
    for x in (ia, ib):
        upto = pc.filter(pc.cumulative_sum(x.is_valid().cast(pa.int64())), both)
        sides.append(pc.binary_join(_lists(upto, pc.take(enc.decimal, x.drop_null())), _join(",")))
    per_group = pc.binary_join_element_wise(*sides, _join("|"))
    for i, s in zip(place, pc.binary_join(_lists(pa.array(np.cumsum(closed)), per_group), _join(";")), strict=True):
        s = s.as_buffer() if not text_groups else s.as_py()
        out["groups"][i] = s if text_groups else hashlib.sha256(s).hexdigest()
    # a stretch lies in the tokens that end next on either side
    pair = pc.add(pc.shift_left(pc.fill_null_backward(ia).cast(pa.int64()), _B_BITS), pc.fill_null_backward(ib).cast(pa.int64()))
    entries = pa.table({"doc": pc.take(good, doc), "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    return out, entries.rename_columns(["doc", "pair", "n"])


class _Chunk:
    """Documents of one task until their texts reach the byte limit."""

    def __init__(self):
        self.bytes, self.n, self.docs, self.entries = 0, 0, [], []

    def add(self, enc: Encoders, ids: pa.Array, texts: list[str | None], text_groups: bool) -> None:
        full = [i for i, t in enumerate(texts) if t]
        got, entries = align_batch(enc, [texts[i] for i in full], text_groups)
        cols = {}
        for k in _COUNTS:
            cols[k] = np.zeros(len(texts), np.int64)
            cols[k][full] = got[k]
        groups = [""] * len(texts)
        for i, g in zip(full, got["groups"], strict=True):
            groups[i] = g
        self.docs.append(pa.table({"id": ids, **cols, "groups": pa.array(groups, pa.large_string())}))
        where = pc.add(pc.take(pa.array(np.array(full, np.int64)), entries["doc"]), self.n)
        self.entries.append(entries.set_column(0, "doc", where))
        self.n += len(texts)

    def rows(self, chunk: int) -> pa.RecordBatch:
        """One row: the documents with their pairs by number, and the pairs with their documents counted."""
        e = pa.concat_tables(self.entries)
        pairs = e.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        coded = e.set_column(1, "code", pc.index_in(e["pair"], pairs["pair"].combine_chunks()))
        docs = pa.concat_tables(self.docs)
        blob = _ipc(docs), _ipc(pa.table({"doc": coded["doc"].cast(pa.int32()), "code": coded["code"], "n": coded["n"].cast(pa.int32())}))
        p = pairs["pair"].combine_chunks()
        ids = pa.list_(pa.int32())
        one = lambda x: pa.ListArray.from_arrays([0, len(x)], x.cast(pa.int32())).cast(ids)
        return pa.record_batch([pa.array([chunk], pa.int64()), pa.array([blob[0]], pa.binary()), pa.array([blob[1]], pa.binary()),
                                one(pc.shift_right(p, _B_BITS)), one(pc.bit_wise_and(p, (1 << _B_BITS) - 1)),
                                one(pairs["count_all"].combine_chunks())],
                               names=["chunk", "docs", "entries", "a", "b", "n"])


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as r:
        return r.read_all()


_known: dict[int, Encoders] = {}


def chunks(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
           groups: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of documents: ``(chunk, docs, entries, a, b, n)``; the
    lists are the distinct linked pairs and how many of the chunk's documents hold each."""
    spark = df.sparkSession
    with open(a_file, encoding="utf-8") as f:
        a_spec = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    sent = spark.sparkContext.broadcast((a_spec, b_model))
    which, as_text = hash((a_spec, b_model)), groups == "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if which not in _known:
            _known.clear()
            _known[which] = Encoders(*sent.value)
        enc, task = _known[which], TaskContext.get().partitionId() << 32
        made, chunk = 0, _Chunk()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                size, upto = 0, at
                while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= BATCH_BYTES):
                    size, upto = size + len(texts[upto] or ""), upto + 1
                if chunk.n and chunk.bytes + size > chunk_bytes:
                    yield chunk.rows(task + made)
                    made, chunk = made + 1, _Chunk()
                chunk.add(enc, ids.slice(at, upto - at), texts[at:upto], as_text)
                chunk.bytes, at = chunk.bytes + size, upto
        if chunk.n:
            yield chunk.rows(task + made)

    small_batches(spark)
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, "chunk long, docs binary, entries binary, a array<int>, b array<int>, n array<int>")


def pair_counts(parts: DataFrame) -> DataFrame:
    """``parts(a, b, n)`` -> ``(a, b, n_docs, best)``: documents that hold the pair
    linked; ``best`` where no pair of the same A id is held by more."""
    total = parts.groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    most = total.groupBy("a").agg(F.max("n_docs").alias("most"))
    return total.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
          groups: str = "text") -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, one row
    per input row.  ``groups`` is the alignment ``a1,a2|b1;a3|b2,b3``, or its
    SHA-256 for ``groups="sha256"`` (empty without tokens)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "token-align")
    table = scratch.cut(chunks(df, a_file, b_file, id_col, text_col, groups))
    zipped = F.posexplode(F.arrays_zip("a", "b", "n"))
    parts = table.select(F.col("chunk").alias("of"), zipped).select("of", F.col("pos").alias("code"), "col.a", "col.b", "col.n")
    counts = scratch.cut(pair_counts(parts))
    totals = parts.drop("n").hint("merge").join(counts, ["a", "b"]).select("of", "code", "n_docs", "best")
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")),
                        T.StructField("groups", T.StringType())])
    id_type = to_arrow_type(kind)

    def finish(docs: pa.Table, known: pa.Table) -> pa.Table:
        tables = [(_table(d), _table(e)) for d, e in zip(docs["docs"].to_pylist(), docs["entries"].to_pylist(), strict=True)]
        (d, e), = tables  # one row per chunk
        size = len(known)
        n_docs, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        code = known["code"].to_numpy()
        n_docs[code], best[code] = known["n_docs"].to_numpy(), known["best"].cast(pa.int64()).to_numpy()
        at, c, n = e["doc"].to_numpy(), e["code"].to_numpy(), e["n"].to_numpy().astype(np.int64)
        sums = {"n_best": np.zeros(len(d), np.int64), "count_sum": np.zeros(len(d), np.int64)}
        np.add.at(sums["n_best"], at, n * best[c])
        np.add.at(sums["count_sum"], at, n * n_docs[c])
        return pa.table([d["id"].cast(id_type), *(d[k] for k in _COUNTS), *map(pa.array, sums.values()), d["groups"].cast(pa.string())],
                        names=[f.name for f in out])

    return table.select("chunk", "docs", "entries").groupBy("chunk").cogroup(totals.groupBy("of")).applyInArrow(finish, out)
