"""Near-duplicate vectors by sorted projection passes.

Only vectors of one label and length are compared.  Equal vectors become one
with a weight.  In every pass a vector's hash bits - on which side of random
hyperplanes it lies - are strung together, the vectors are sorted by (label,
bits), and each is compared with the next ``window`` ones: near vectors share
long prefixes.  A task works through its stretch of the order; the vectors
around a cut between two tasks meet in a second step, so the cuts lose nothing.
What reaches the threshold is joined by a union-find per block, and the
edges of all passes give the components.

Two linked vectors lie in one component, so links are then counted inside
components, completely: in an order in which near vectors stand together a
component is cut into balls of at most ``BALL`` vectors.  Angles between the
centres decide most pairs of balls (all linked, none linked); the others are
compared vector by vector in blocks.  A component that fits into half the
angle is decided by its own centre and radius.  No pairs are written.

What the passes find is a matter of chance for each pair that nothing else
connects: with ``passes`` independent orders a pair at cosine 0.93 that shares
its first 12 bits (prob. 0.21) or more stands within a window; 24 passes miss
0.4 % of such pairs, at cosine 0.98 less than one in 10^9.

Defined results: a null, empty or zero vector, one that holds a null or a value
that is not finite, and any vector without a label links with nothing.
Repeated rows are vectors of their own.  A null id counts as greater than any
other; it is a component's id only if all its ids are null.  An empty table
gives an empty result.  Other columns of the input are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .graph import components

PASSES, WINDOW, BITS = 24, 64, 62
BALL = 512
#: Vectors a task sorts in one pass, about.
TASK_ROWS = 200_000
_STEP = 256
_SLACK = 1e-7  # radians: what rounding may add to an angle


def unit(v: np.ndarray) -> np.ndarray:
    """Rows brought to length 1 in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as unit rows."""
    return unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))


def _usable(vec: pa.Array, kind: str) -> list[bytes | None]:
    """The components as bytes; None for vectors that link with nothing."""
    out: list[bytes | None] = []
    # nulls turn NaN, -0 turns 0
    values = vec.values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(kind) + np.array(0, kind)
    offsets = vec.offsets.to_numpy()
    for ok, a, b in zip(vec.is_valid().to_pylist(), offsets, offsets[1:], strict=False):
        v = values[a:b]
        out.append(v.tobytes() if ok and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _sides(v: np.ndarray, count: int) -> np.ndarray:
    """Hash bits of the first ``count`` passes as longs, one column per pass."""
    out = np.empty((len(v), count), np.int64)
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for p in range(count):
        planes = np.random.RandomState(1000 + p).standard_normal((v.shape[1], BITS))
        out[:, p] = ((v @ planes) > 0) @ weight
    return out


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _window_edges(v: np.ndarray, ids: np.ndarray, window: int, cosine: float, upto: int) -> list[tuple]:
    """Rows in order: each of the first ``upto`` against the next ``window``;
    a spanning forest of the links found."""
    found, union = [], _Union(len(v))
    for a in range(0, upto, _STEP):
        b = min(a + _STEP, upto)
        near = v[a:b] @ v[a:b + window].T >= cosine
        gap = np.arange(near.shape[1]) - np.arange(b - a)[:, None]
        near &= (gap > 0) & (gap <= window)
        # A link that two others make up, by the next row, joins nothing.
        step = near[np.arange(b - a - 1), np.arange(1, b - a)]
        told = step[:, None] & near[1:]
        near[:-1] &= ~told
        i, j = np.nonzero(near)
        for x, y in zip((i + a).tolist(), (j + a).tolist(), strict=True):
            if union.join(x, y):
                found.append((int(ids[x]), int(ids[y])))
    return found


_ORDERED = T.StructType([T.StructField(n, t) for n, t in (
    ("group", T.LongType()), ("pass", T.IntegerType()), ("bits", T.LongType()), ("vid", T.LongType()), ("v", T.BinaryType()))])
_FOUND = T.StructType([T.StructField(n, t) for n, t in (
    ("a", T.LongType()), ("b", T.LongType()), ("part", T.IntegerType()), ("at", T.LongType()), ("of", T.LongType()),
    ("group", T.LongType()), ("pass", T.IntegerType()), ("vid", T.LongType()), ("v", T.BinaryType()))])


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of stretches in which no key changes."""
    n = len(keys[0])
    if not n:
        return []
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(cuts, cuts[1:], strict=False))


def _sorted_windows(window: int, cosine: float, kind: str):
    """Task over one stretch of the order: edges, then its first and last ``window`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        head: list[tuple] = []
        held = None
        edges: list[tuple] = []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if len(head) < window:
                head += [(at + i, r["group"], r["pass"], r["vid"], r["v"]) for i, r in enumerate(rows.slice(0, window - len(head)).to_pylist())]
            at += len(rows)
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            done = max(0, len(rows) - window)  # the last ones still wait for their partners
            edges += _compare(rows, window, cosine, done, kind)
            held = rows.slice(done)
            if len(edges) > 50_000:
                yield _found(edges, [], part, at)
                edges = []
        if held is None:
            return
        edges += _compare(held, window, cosine, len(held), kind)
        tail = [(at - len(held) + i, r["group"], r["pass"], r["vid"], r["v"]) for i, r in enumerate(held.to_pylist())]
        ends = {r[0]: r for r in head + tail[-window:]}
        yield _found(edges, [ends[k] for k in sorted(ends)], part, at)

    return run


def _compare(rows: pa.Table, window: int, cosine: float, upto: int, kind: str) -> list[tuple]:
    """Edges of the first ``upto`` rows with the rows that follow them, within (pass, group)."""
    if not upto:
        return []
    rows = rows.combine_chunks()
    g, p, ids = (rows[c].to_numpy() for c in ("group", "pass", "vid"))
    raw = rows["v"].to_pylist()
    out = []
    for a, b in _runs(g, p):
        if a < upto and b - a > 1:
            out += _window_edges(unit_rows(raw[a:b], kind), ids[a:b], window, cosine, min(b, upto) - a)
    return out


def _found(edges: list[tuple], ends: list[tuple], part: int, of: int) -> pa.RecordBatch:
    n, m = len(edges), len(ends)
    none = [None] * n
    cols = [[e[0] for e in edges] + [None] * m, [e[1] for e in edges] + [None] * m, [part] * (n + m), none + [r[0] for r in ends],
            none + [of] * m, *(none + [r[k] for r in ends] for k in (1, 2, 3, 4))]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_FOUND.names)


def _cuts(sizes: list[tuple[int, int]], window: int) -> list[tuple[int, int, int]]:
    """Parts with their rows, in order -> ``(part, cut, side)``: whose end rows meet at
    which cut.  Parts shorter than the window pass the cut on to the next ones."""
    out = []
    for k in range(len(sizes) - 1):
        out.append((sizes[k][0], k, 0))
        reach, j = 0, k + 1
        while j < len(sizes) and reach < window:
            out.append((sizes[j][0], k, 1))
            reach, j = reach + sizes[j][1], j + 1
    return out


def _at_cut(window: int, cosine: float, kind: str):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("at", "ascending")]).combine_chunks()
        before = rows.filter(pc.equal(rows["side"], 0))
        after = rows.filter(pc.equal(rows["side"], 1))
        before = before.slice(max(0, len(before) - window))
        after = after.filter(pc.less(after["at"], window))
        both = pa.concat_tables([before, after.slice(0, window)])
        edges = _compare(both, window, cosine, len(before), kind)
        return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return run


def pass_edges(vectors: DataFrame, scratch: Scratch, cosine: float, kind: str, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """``vectors(group, vid, v)`` -> ``(a, b)``: a forest of each block's verified links."""
    spark = vectors.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            size = np.array([len(r) for r in raw])
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                v = unit_rows([raw[i] for i in mine], kind)
                one = batch.take(pa.array(mine))
                for p, bits in enumerate(_sides(v, passes).T):
                    yield pa.record_batch([one.column(0), pa.array(np.full(len(mine), p, np.int32)), pa.array(bits), one.column(1), one.column(2)],
                                          names=_ORDERED.names)

    count = vectors.count()
    parts = max(1, -(-count * passes // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = vectors.select("group", "vid", "v").mapInArrow(keys, _ORDERED) \
        .repartitionByRange(parts, "pass", "group", "bits", "vid").sortWithinPartitions("pass", "group", "bits", "vid")
    found = scratch.cut(ordered.mapInArrow(_sorted_windows(window, cosine, kind), _FOUND))
    # one row per task: how many rows each holds
    sizes = sorted((r["part"], r["n"]) for r in found.where("of is not null").groupBy("part").agg(F.max("of").alias("n")).collect())
    at = spark.createDataFrame(_cuts(sizes, window), "part int, cut int, side int")
    meet = found.where("of is not null").join(F.broadcast(at), "part").select("cut", "side", "part", "at", "of", "group", "pass", "vid", "v")
    more = meet.groupBy("cut").applyInArrow(_at_cut(window, cosine, kind), "a long, b long")
    return found.where("a is not null").select("a", "b").unionByName(more)


# ------------------------------------------------------------ counting links
def _angle(cosine) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _make_balls(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by root -> one row per ball: its vectors, centre, radius and weights."""
    task, made, held = TaskContext.get().partitionId() << 32, 0, None

    def rows(t: pa.Table) -> pa.RecordBatch:
        nonlocal made
        out = []
        t = t.combine_chunks()
        raw, w, ids, root = t["v"].to_pylist(), t["m"].to_numpy(), t["vid"].to_numpy(), t["root"].to_numpy()
        for a, b in _runs(root):
            for i in range(a, b, BALL):
                j = min(i + BALL, b)
                v = unit_rows(raw[i:j], kind)
                mid = v.sum(axis=0)
                size = np.linalg.norm(mid)
                mid = mid / size if size > 1e-9 else v[0]
                out.append((int(root[i]), task + made, ids[i:j].tobytes(), w[i:j].tobytes(), b"".join(raw[i:j]),
                            mid.tobytes(), float(_angle(v @ mid).max()) + _SLACK, int(w[i:j].sum()), j - i))
                made += 1
        return pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=_BALLS.names)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        root = t["root"].to_numpy()
        keep = len(t) - (np.flatnonzero(root != root[-1]).max(initial=-1) + 1)  # rows of the last root
        keep = keep % BALL if keep >= BALL else keep
        if keep < len(t):
            yield rows(t.slice(0, len(t) - keep))
        held = t.slice(len(t) - keep) if keep else None
    if held is not None and len(held):
        yield rows(held)


_BALLS = T.StructType([T.StructField(n, t) for n, t in (
    ("root", T.LongType()), ("ball", T.LongType()), ("ids", T.BinaryType()), ("w", T.BinaryType()), ("vs", T.BinaryType()),
    ("mid", T.BinaryType()), ("radius", T.DoubleType()), ("weight", T.LongType()), ("n", T.LongType()))])


def _pairs_of_balls(cosine: float):
    limit = float(np.arccos(cosine))

    def run(t: pa.Table) -> pa.Table:
        """The balls of one root -> ``(ball, base, other)``: the weight surely linked
        to all of a ball's vectors, and the balls to compare it with."""
        ids, w, r = t["ball"].to_numpy(), t["weight"].to_numpy(), t["radius"].to_numpy()
        mid = np.frombuffer(b"".join(t["mid"].to_pylist()), np.float64).reshape(len(t), -1)
        whole = (mid * t["n"].to_numpy()[:, None]).sum(axis=0)
        size = np.linalg.norm(whole)
        if size > 1e-9 and 2 * (_angle(mid @ (whole / size)) + r).max() <= limit - _SLACK:
            return pa.table([t["ball"], pa.array(np.full(len(t), w.sum())), pa.array([[]] * len(t), pa.list_(pa.int64()))], names=["ball", "base", "others"])
        base, others = [], []
        for i in range(len(t)):
            gap = _angle(mid @ mid[i])
            gap[i] = 0.0
            sure = gap + r + r[i] <= limit - _SLACK
            open_ = ~sure & (gap - r - r[i] <= limit + _SLACK) & (np.arange(len(t)) >= i)
            base.append(int(w[sure].sum()))
            others.append(ids[open_].tolist())
        return pa.table([t["ball"], pa.array(base, pa.int64()), pa.array(others, pa.list_(pa.int64()))], names=["ball", "base", "others"])

    return run


def _compare_balls(cosine: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [np.frombuffer(r[k], np.int64) for k in ("ids", "ids2")]
                w = [np.frombuffer(r[k], np.int64) for k in ("w", "w2")]
                v = [unit(np.frombuffer(r[k], kind).reshape(len(i), -1)) for k, i in zip(("vs", "vs2"), ids, strict=True)]
                near = v[0] @ v[1].T >= cosine
                if r["ball"] == r["other"]:
                    near |= np.eye(len(near), dtype=bool)
                who, add = [ids[0]], [near @ w[1]]
                if r["ball"] != r["other"]:
                    who, add = [*who, ids[1]], [*add, w[0] @ near]
                yield pa.record_batch([pa.array(np.concatenate(who)), pa.array(np.concatenate(add).astype(np.int64))], names=["vid", "add"])

    return run


def count_links(members: DataFrame, scratch: Scratch, cosine: float, kind: str) -> DataFrame:
    """``members(vid, root, bits, v, m)`` -> ``(vid, linked)``: the weight of all vectors
    of the component at ``cosine`` or above, the vector's own included."""
    ordered = members.select("root", "bits", "vid", "v", "m").repartitionByRange("root", "bits", "vid").sortWithinPartitions("root", "bits", "vid")
    balls = scratch.cut(ordered.mapInArrow(lambda batches: _make_balls(batches, kind), _BALLS))
    many = balls.groupBy("root").agg(F.count("*").alias("balls")).where("balls > 1").select("root")
    about = balls.select("root", "ball", "mid", "radius", "weight", "n")
    # a component of one ball needs no other
    sure = 2 * F.col("radius") <= float(np.arccos(cosine)) - _SLACK
    alone = about.join(many, "root", "left_anti").select(
        "ball", F.when(sure, F.col("weight")).otherwise(0).alias("base"), F.when(sure, F.array().cast("array<long>")).otherwise(F.array("ball")).alias("others"))
    plan = scratch.cut(alone.unionByName(about.join(many, "root", "left_semi").groupBy("root").applyInArrow(
        _pairs_of_balls(cosine), "ball long, base long, others array<long>")))
    pairs = plan.select("ball", F.explode("others").alias("other"))
    left = balls.select("ball", "ids", "w", "vs")
    right = balls.select(F.col("ball").alias("other"), F.col("ids").alias("ids2"), F.col("w").alias("w2"), F.col("vs").alias("vs2"))
    met = pairs.hint("merge").join(left, "ball").hint("merge").join(right, "other").mapInArrow(_compare_balls(cosine, kind), "vid long, add long")
    base = balls.select("ball", "ids").join(plan.select("ball", "base"), "ball").mapInArrow(_each_id, "vid long, add long")
    return base.unionByName(met).groupBy("vid").agg(F.sum("add").alias("linked"))


def _each_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            yield pa.record_batch([pa.array(ids), pa.array(np.full(len(ids), r["base"], np.int64))], names=["vid", "add"])


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.93, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``, one row per input row: ``n_links``
    other rows at ``cosine`` or above, the least id reachable by links, and
    whether that is the row's own."""
    spark = df.sparkSession
    scratch = Scratch(spark, "projection-passes")
    id_type = df.schema[id_col].dataType
    kind = "<f4" if df.schema[vec_col].dataType == T.ArrayType(T.FloatType(), df.schema[vec_col].dataType.containsNull) else "<f8"

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _usable(batch.column(2), kind)
            raw = [v if ok else None for v, ok in zip(raw, batch.column(1).is_valid().to_pylist(), strict=True)]
            key = [None if v is None else hashlib.md5(v).digest() for v in raw]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(key, pa.binary())], names=["id", "label", "v", "key"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", df.schema[label_col].dataType),
                           T.StructField("v", T.BinaryType()), T.StructField("key", T.BinaryType())])
    rows = scratch.cut(df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).mapInArrow(prepare, schema))
    usable = rows.where("v is not null")
    # The number of a distinct vector: where it stands in the written table; its group: label and length.
    distinct = scratch.cut(usable.groupBy("label", "key").agg(F.first("v").alias("v"), F.count("*").alias("m"), F.min("id").alias("least"))
                           .select(F.monotonically_increasing_id().alias("vid"), F.xxhash64("label", F.length("v")).alias("group"), "label", "key", "v", "m", "least"))
    root = scratch.cut(components(pass_edges(distinct, scratch, cosine, kind, passes, window), scratch).select(F.col("node").alias("vid"), "root"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            size, key = np.array([len(r) for r in raw]), np.zeros(len(raw), np.int64)
            for n in np.unique(size):
                mine = np.flatnonzero(size == n)
                key[mine] = _sides(unit_rows([raw[i] for i in mine], kind), 1)[:, 0]
            yield batch.append_column("bits", pa.array(key))

    members = distinct.select("vid", "v", "m").join(root, "vid").select("vid", "root", "v", "m") \
        .mapInArrow(bits, "vid long, root long, v binary, m long, bits long")
    linked = count_links(members, scratch, cosine, kind)
    least = distinct.select("vid", "least").join(root, "vid").groupBy("root").agg(F.min("least").alias("least_id"))
    named = root.join(least, "root").join(linked, "vid").select("vid", "least_id", "linked")
    done = scratch.cut(distinct.select("vid", "label", "key", "m", "least").join(named, "vid", "left").select(
        "label", "key", (F.coalesce("linked", "m") - 1).alias("n_links"), F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("least_id")).alias("component_id")))
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    grouped = usable.select("id", "label", "key").join(done, ["label", "key"]).select("id", "n_links", "component_id")
    return grouped.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
