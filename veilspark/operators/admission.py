"""Token-bucket admission per key (T1-T3), batch form.

Semantics per key, in (ts, id) order: a bucket starts full (``burst``
tokens); before each request it refills ``rpm/60`` tokens per second, capped
at ``burst``; a request is admitted iff at least one token is there (and
spends it), otherwise it is refused with ``retry_after = (1 - tokens) /
rate`` rounded to 0.1 s.  A bucket idle for more than ``stale_seconds`` is
evicted, i.e. the next request starts a fresh full bucket (event-time TTL).

Arithmetic is exact.  Time is counted in ticks of which a whole number make a
microsecond's refill and a whole number (``cost``) a token; a bucket's state is
the time ``z`` at which it will be full again.  A request at ``t`` passes if
``z <= t + slack`` (``slack`` = (burst - 1) tokens), and then
``z = max(z, t) + cost``.

Parallel plan.  Events are range-partitioned on (key, ts, id) and
checkpointed, so a busy key's history is cut by time into slices on many
tasks.  A slice that some other one precedes cannot know its entry state, so
it works out its whole state map instead (``state_map``): exit state by entry
state, in a few pieces.

* Requests only ever add ``cost`` to ``z``, so ``z`` keeps its remainder modulo
  ``cost``.  Entry states of one stretch of length ``cost`` stay in one moving
  stretch ``(low, low + cost]`` - whatever the remainder - and ``low`` alone
  tells where: ``low`` becomes ``min(t + slack, low + cost)`` when ``t + slack``
  reaches it.  Such stretches become equal as soon as the bucket runs empty.
* What finds its bucket full again forgets its entry state: a piece with one
  value.  Such values become equal as soon as the bucket is full again.

So a handful of numbers per slice stand for every possible entry state.  One
row per task goes to the driver, which follows each key through the maps of
its slices; a second pass over the same slices emits the decisions.  A key
that is never idle runs on as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..session import checkpoint_dir

OUT_SCHEMA = "k string, ts_s double, id long, allowed boolean, retry_after double, tokens_after double"


def _epoch_seconds(events: DataFrame, ts_col: str):
    if _is_numeric(events, ts_col):
        return F.col(ts_col).cast("double")
    return F.unix_micros(F.col(ts_col).cast("timestamp")) / 1e6


def _resets(k: np.ndarray, ts: np.ndarray, stale: float, full: float) -> np.ndarray:
    """Reset flag of every row but the first, from the gap to the row before."""
    out = np.ones(len(k), dtype=bool)
    if len(k) > 1:
        gap = ts[1:] - ts[:-1]
        out[1:] = (k[1:] != k[:-1]) | (gap > stale) | (gap >= full)
    return out


def with_segments(events: DataFrame, key_col: str, ts_col: str, id_col: str, rpm: float, burst: int,
                  stale_seconds: float = catalog.BUCKET_STALE_SECONDS, partitions: int | None = None) -> DataFrame:
    """Adds ``ts_s`` (epoch seconds) and ``seg`` (id of the segment's first event)."""
    spark = events.sparkSession
    checkpoint_dir(spark)
    full = burst / (rpm / 60.0)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = events.select(F.col(key_col).cast("string").alias("k"), _epoch_seconds(events, ts_col).alias("ts_s"),
                         F.col(id_col).cast("long").alias("id"))
    ranged = (base.repartitionByRange(n, "k", "ts_s", "id").sortWithinPartitions("k", "ts_s", "id")
              .withColumn("pid", F.spark_partition_id()).checkpoint())

    def summarize(batches):
        first = last = last_reset = None
        prev = None
        for pdf in batches:
            if pdf.empty:
                continue
            k, ts, ids = pdf["k"].to_numpy(), pdf["ts_s"].to_numpy(dtype=np.float64), pdf["id"].to_numpy()
            r = _resets(k, ts, stale_seconds, full)
            if prev is None:
                first = (pdf["pid"].iat[0], k[0], ts[0], ids[0])
                r[0] = False            # decided on the driver
            else:
                g = ts[0] - prev[1]
                r[0] = (k[0] != prev[0]) or g > stale_seconds or g >= full
            idx = np.flatnonzero(r)
            if len(idx):
                j = idx[-1]
                last_reset = (k[j], ts[j], ids[j])
            prev = (k[-1], ts[-1], ids[-1])
            last = prev
        if first is not None:
            lr = last_reset if last_reset is not None and last_reset[0] == last[0] else (None, None, None)
            yield pd.DataFrame({"pid": [int(first[0])], "fk": [first[1]], "fts": [first[2]], "fid": [first[3]],
                                "lk": [last[0]], "lts": [last[1]], "lid": [last[2]],
                                "rk": [lr[0]], "rts": [lr[1]], "rid": [lr[2]]})

    schema = ("pid int, fk string, fts double, fid long, lk string, lts double, lid long, "
              "rk string, rts double, rid long")
    summary = ranged.mapInPandas(summarize, schema).collect()   # at most one row per partition
    entry: dict[int, tuple] = {}       # pid -> (first row continues?, segment id of first row)
    carry = None                       # (key, last ts, open segment id) at the end of the previous partition
    for r in sorted(summary, key=lambda x: x.pid):
        cont = (carry is not None and carry[0] == r.fk and not (r.fts - carry[1] > stale_seconds)
                and not (r.fts - carry[1] >= full))
        seg0 = carry[2] if cont else r.fid
        entry[r.pid] = (cont, seg0)
        if r.rk is not None:
            open_seg = r.rid
        elif r.lk == r.fk:
            open_seg = seg0
        else:  # last run began at a key change, which is a local reset
            open_seg = r.rid
        carry = (r.lk, r.lts, open_seg)

    def label(batches):
        prev = None
        seg = None
        for pdf in batches:
            if pdf.empty:
                continue
            k, ts, ids = pdf["k"].to_numpy(), pdf["ts_s"].to_numpy(dtype=np.float64), pdf["id"].to_numpy()
            r = _resets(k, ts, stale_seconds, full)
            if prev is None:
                cont, seg0 = entry[int(pdf["pid"].iat[0])]
                r[0] = not cont
                seg = seg0
            else:
                g = ts[0] - prev[1]
                r[0] = (k[0] != prev[0]) or g > stale_seconds or g >= full
            starts = np.where(r, ids, -1)
            # segment id = id of the latest reset row at or before each row
            pos = np.maximum.accumulate(np.where(r, np.arange(len(k)), -1))
            segs = np.where(pos >= 0, starts[np.maximum(pos, 0)], seg)
            seg = segs[-1]
            prev = (k[-1], ts[-1])
            yield pd.DataFrame({"k": k, "ts_s": ts, "id": ids, "seg": segs.astype(np.int64)})

    return ranged.mapInPandas(label, "k string, ts_s double, id long, seg long")


def _is_numeric(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in ("double", "float", "long", "integer", "decimal")


class Clock:
    """Whole numbers for a bucket: ticks per microsecond, per token, of slack, of eviction."""

    def __init__(self, rpm: float, burst: int, stale_seconds: float):
        per_us = Fraction(rpm).limit_denominator(1_000_000) / 60_000_000  # tokens a microsecond
        self.tick, self.cost = per_us.numerator, per_us.denominator
        self.full = burst * self.cost
        self.slack = self.full - self.cost
        self.stale_us = round(stale_seconds * 1e6)

    def time(self, us: np.ndarray) -> list[int]:
        return [x * self.tick for x in us.tolist()]  # Python's integers have no limit


class Piece:
    """Entry states in ``(low, high]`` share a way: they follow a stretch, or have one value."""

    __slots__ = ("low", "high", "way")

    def __init__(self, low: int, high: int, way: list):
        self.low, self.high, self.way = low, high, way


def _split(piece: Piece, low: int, cost: int, t: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Entry intervals of a piece on the stretch ``(low, low + cost]`` that now are up to ``t``, and those above."""
    under, above = [], []
    a = piece.low
    while a < piece.high:
        at = low + (a - low) % cost  # where the interval's start is; it runs up to the stretch's end
        b = min(piece.high, a + low + cost - at)
        cut = min(max(a + t - at, a), b)
        if a < cut:
            under.append((a, cut))
        if cut < b:
            above.append((cut, b))
        a = b
    return under, above


def state_map(times: list[int], clock: Clock) -> list[tuple[int, int, bool, int]]:
    """Slice of one key's request times -> ``(low, high, keeps, value)``: for entry states
    in ``(low, high]`` (at the first request, from its time to ``full`` later) the exit
    state is ``value``, or, where ``keeps``, the one in ``(value, value + cost]`` that
    differs from the entry state by whole tokens."""
    cost, slack, start = clock.cost, clock.slack, times[0]
    # a way is [is a stretch, its low end or the value]
    fresh = [False, start]
    bands = [[True, start + low] for low in range(0, clock.full, cost)]
    pieces = [Piece(start - 1, start, fresh)] + [Piece(w[1], w[1] + cost, w) for w in bands]
    points = [fresh]
    for t in times:
        reach = t + slack
        moved = False
        clipped = None
        for w in bands:
            low = w[1]
            if t > low:
                clipped = [False, t] if clipped is None else clipped
                gone = t >= low + cost
                kept = []
                for p in pieces:
                    if p.way is not w:
                        kept.append(p)
                    elif gone:
                        kept.append(Piece(p.low, p.high, clipped))
                    else:
                        under, above = _split(p, low, cost, t)
                        kept += [Piece(a, b, clipped) for a, b in under] + [Piece(a, b, w) for a, b in above]
                pieces = kept
                w[1] = min(reach, low + cost)
                moved = True
            elif reach > low:
                w[1] = min(reach, low + cost)
                moved = True
        if clipped is not None:
            points.append(clipped)
        for w in points:
            if w[1] <= reach:
                w[1] = max(w[1], t) + cost
                moved = True
        if moved and len(bands) + len(points) > 1:
            pieces, bands, points = _merged(pieces, bands, points, clipped is not None)
    return [(p.low, p.high, p.way[0], p.way[1]) for p in pieces]


def _merged(pieces: list[Piece], bands: list[list], points: list[list], look: bool) -> tuple[list[Piece], list[list], list[list]]:
    """Ways that have become equal are one from here on; ways without pieces end."""
    if not look and len({w[1] for w in bands}) == len(bands) and len({w[1] for w in points}) == len(points):
        return pieces, bands, points
    one: dict[tuple, list] = {}
    out: list[Piece] = []
    for p in pieces:
        p.way = one.setdefault((p.way[0], p.way[1]), p.way)
        if out and out[-1].way is p.way and out[-1].high == p.low:
            out[-1].high = p.high
        else:
            out.append(p)
    ways = list(one.values())
    return out, [w for w in ways if w[0]], [w for w in ways if not w[0]]


def follow(pieces: list[tuple[int, int, bool, int]], z: int, cost: int) -> int:
    """The exit state of entry state ``z``."""
    for low, high, keeps, value in pieces:
        if low < z <= high:
            return value + 1 + (z - value - 1) % cost if keeps else value
    raise ValueError("state outside the map")


def _runs(k: np.ndarray, us: np.ndarray, stale_us: int) -> np.ndarray:
    """Where a new bucket starts, seen from the row before; the first row does not count."""
    cut = np.zeros(len(k), dtype=bool)
    cut[1:] = (k[1:] != k[:-1]) | (us[1:] - us[:-1] > stale_us)
    return cut


def _slice_summary(clock: Clock):
    """One row per task: its first and last request, and either the exit state of its
    last bucket or, where one bucket covers the whole task, the state map."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        held: list[np.ndarray] = []  # times since the last bucket began
        whole = True
        for pdf in batches:
            if pdf.empty:
                continue
            k, us = pdf["k"].to_numpy(), pdf["us"].to_numpy()
            cut = _runs(k, us, clock.stale_us)
            if first is None:
                first = (int(pdf["pid"].iat[0]), k[0], int(us[0]))
            else:
                cut[0] = k[0] != last[0] or us[0] - last[1] > clock.stale_us
            at = np.flatnonzero(cut)
            if len(at):
                held, whole = [us[at[-1]:]], False
            else:
                held.append(us)
            last = (k[-1], int(us[-1]))
        if first is None:
            return
        times = clock.time(np.concatenate(held))
        pieces = state_map(times, clock) if whole else []
        z = None
        if not whole:
            z = times[0]
            for t in times:
                if z <= t + clock.slack:
                    z = max(z, t) + clock.cost
        yield pd.DataFrame({"pid": [first[0]], "fk": [first[1]], "fus": [first[2]], "lk": [last[0]], "lus": [last[1]],
                            "z": [None if z is None else str(z)], "pieces": [[f"{a},{b},{int(c)},{d}" for a, b, c, d in pieces]]})

    return run


_SUMMARY = "pid int, fk string, fus long, lk string, lus long, z string, pieces array<string>"


def _entries(summary: list, clock: Clock) -> dict[int, int]:
    """Task -> entry state of its first request, for tasks that go on with a key's bucket."""
    out: dict[int, int] = {}
    carry = None  # (key, time of its last request, state)
    for r in sorted(summary, key=lambda x: x.pid):
        entry = r.fus * clock.tick
        if carry is not None and carry[0] == r.fk and r.fus - carry[1] <= clock.stale_us:
            entry = max(entry, carry[2])
            out[r.pid] = entry
        if r.z is None:
            pieces = [(int(a), int(b), c == "1", int(d)) for a, b, c, d in (p.split(",") for p in r.pieces)]
            carry = (r.lk, r.lus, follow(pieces, entry, clock.cost))
        else:
            carry = (r.lk, r.lus, int(r.z))
    return out


#: Buckets with more requests in a batch than this are folded one by one, the others side by side.
_SIDE_BY_SIDE = 64


def _decide(us: np.ndarray, start: np.ndarray, z0: np.ndarray, clock: Clock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Requests of several buckets, one after the other (``start``: first row of each) with
    their entry states -> (passes, tokens after in ticks, exit state of each bucket).
    States are kept relative to the batch's first time, in ticks."""
    n = len(us)
    size = np.diff(np.append(start, n))
    wide = (int(us.max()) - int(us.min())) * clock.tick + 2 * clock.full >= 1 << 62
    t = (us - us.min()).astype(object if wide else np.int64) * clock.tick
    z0 = z0.astype(t.dtype)
    ok, level = np.empty(n, dtype=bool), np.empty(n, dtype=t.dtype)
    end = z0.copy()
    for j in np.flatnonzero(size > _SIDE_BY_SIDE).tolist():
        z, a, b = int(z0[j]), int(start[j]), int(start[j] + size[j])
        passes, after, slack, cost = [], [], clock.slack, clock.cost
        for now in t[a:b].tolist():
            z = z if z > now else now
            if z <= now + slack:
                z += cost
                passes.append(True)
            else:
                passes.append(False)
            after.append(now - z)
        ok[a:b], level[a:b], end[j] = passes, after, z
    short = np.flatnonzero(size <= _SIDE_BY_SIDE)
    short = short[np.argsort(-size[short], kind="stable")]
    z = z0[short]
    for step in range(int(size[short[0]]) if len(short) else 0):
        m = int(np.searchsorted(-size[short], -step, side="left"))  # buckets that have such a request
        row = start[short[:m]] + step
        now = t[row]
        z[:m] = np.maximum(z[:m], now)
        passed = z[:m] <= now + clock.slack
        z[:m] += np.where(passed, clock.cost, 0)
        ok[row], level[row] = passed, now - z[:m]
    end[short] = z
    return ok, level + clock.full, end


def _decisions(clock: Clock, entry: dict[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # (key, time, state) of the row before
        for pdf in batches:
            if pdf.empty:
                continue
            k, us = pdf["k"].to_numpy(), pdf["us"].to_numpy()
            base = int(us.min()) * clock.tick
            start = np.flatnonzero(_runs(k, us, clock.stale_us))
            start = np.concatenate([[0], start]).astype(np.int64)
            z0 = [(int(x) * clock.tick) - base for x in us[start]]  # full buckets
            if last is None:
                first = entry.get(int(pdf["pid"].iat[0]))
            else:
                first = last[2] if k[0] == last[0] and us[0] - last[1] <= clock.stale_us else None
            if first is not None:
                z0[0] = max(z0[0], first - base)
            ok, level, end = _decide(us, start, np.array(z0, dtype=object), clock)
            last = (k[-1], int(us[-1]), int(end[-1]) + base)
            yield pd.DataFrame({"k": k, "ts_s": us / 1e6, "id": pdf["id"].to_numpy(), "allowed": ok,
                                "retry_after": _retry_after(ok, level, clock), "tokens_after": level.astype(np.float64) / clock.cost})

    return run


def decide_in_order(us: np.ndarray, clock: Clock, z: int | None = None, last: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """One key's next requests in order, after state ``z`` at time ``last`` -> (passes, retry_after, state)."""
    base = int(us[0]) * clock.tick
    start = np.concatenate([[0], np.flatnonzero(us[1:] - us[:-1] > clock.stale_us) + 1]).astype(np.int64)
    z0 = [int(x) * clock.tick - base for x in us[start]]
    if z is not None and int(us[0]) - last <= clock.stale_us:
        z0[0] = max(0, z - base)
    ok, level, end = _decide(us, start, np.array(z0, dtype=object), clock)
    return ok, _retry_after(ok, level, clock), int(end[-1]) + base


def _retry_after(ok: np.ndarray, level: np.ndarray, clock: Clock) -> np.ndarray:
    return np.where(ok, 0.0, np.round((clock.cost - level.astype(np.float64)) / (clock.tick * 1e6), 1))


def token_bucket(events: DataFrame, key_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id",
                 rpm: float = catalog.DEFAULT_RPM, burst: int = catalog.DEFAULT_BURST,
                 stale_seconds: float = catalog.BUCKET_STALE_SECONDS, partitions: int | None = None) -> DataFrame:
    """Per-request decisions: ``(k, ts_s, id, allowed, retry_after, tokens_after)``.
    A request without a time has no place in the order: its decision is null."""
    spark = events.sparkSession
    checkpoint_dir(spark)
    clock = Clock(rpm, burst, stale_seconds)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = events.select(F.col(key_col).cast("string").alias("k"), _epoch_micros(events, ts_col).alias("us"), F.col(id_col).cast("long").alias("id"))
    ranged = (base.where("us is not null").repartitionByRange(n, "k", "us", "id").sortWithinPartitions("k", "us", "id")
              .withColumn("pid", F.spark_partition_id()).checkpoint())
    summary = ranged.mapInPandas(_slice_summary(clock), _SUMMARY).collect()  # at most one row per task
    out = ranged.mapInPandas(_decisions(clock, _entries(summary, clock)), OUT_SCHEMA)
    none = base.where("us is null").select("k", F.lit(None).cast("double").alias("ts_s"), "id", F.lit(None).cast("boolean").alias("allowed"),
                                           F.lit(None).cast("double").alias("retry_after"), F.lit(None).cast("double").alias("tokens_after"))
    return out.unionByName(none)


def _epoch_micros(events: DataFrame, ts_col: str):
    if _is_numeric(events, ts_col):
        return F.round(F.col(ts_col).cast("double") * 1e6).cast("long")
    return F.unix_micros(F.col(ts_col).cast("timestamp"))


def segment_report(events: DataFrame, key_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id",
                   rpm: float = catalog.DEFAULT_RPM, burst: int = catalog.DEFAULT_BURST) -> DataFrame:
    """Largest independent segment per key (the unit of parallelism)."""
    seg = with_segments(events, key_col, ts_col, id_col, rpm, burst)
    per = seg.groupBy("k", "seg").count()
    return per.groupBy("k").agg(F.count("*").alias("segments"), F.max("count").alias("largest_segment"))
