"""Token-bucket admission on a stream whose rows arrive out of order.

State per key (``transformWithState``, rows: a
pandas frame for each key costs more than its few rows): the list of rows that wait for
the watermark, and the bucket.  Arriving rows are only added to the list.  An
event-time timer at the earliest waiting row goes off once the watermark has
passed it; then all rows up to the watermark are decided in event-time order,
so the decisions are those of the batch operator whatever the order of
arrival within the watermark's delay.  A second timer, ``stale_seconds`` after
the last decided row, clears the state of a key that has gone quiet.

Rows behind the watermark do not reach the operator (Spark drops and counts
them), and the rows of the last ``watermark`` wait until later ones arrive: a
source that ends, or falls silent, needs a heartbeat row to let them go.

Needs the RocksDB state store (``STATE_STORE``); ``runner.run_to_table`` sets
it for the query it starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import catalog
from ..operators.admission import Clock, decide_in_order

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT_SCHEMA = "k string, id long, ts_s double, allowed boolean, retry_after double"


class _Bucket(StatefulProcessor):
    def __init__(self, clock: Clock):
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one entry for the rows of a micro-batch: an entry is pickled and parsed by itself
        self.waiting = handle.getListState("waiting", "rows binary")
        # the state's whole number may be longer than a long; the time of the last decided row
        self.bucket = handle.getValueState("bucket", "z string, us long")
        # keys of this task whose rows up to the watermark are decided: their other timers find nothing more
        self.settled = set()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.us, r.id) for r in rows]
        if new:
            self.waiting.appendValue((_packed(new),))
            self.handle.registerTimer(_due(min(new)[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if key in self.settled:
            return
        self.settled.add(key)
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [r for entry in self.waiting.get() for r in _unpacked(entry[0])]
        ready = sorted(r for r in rows if r[0] <= upto)
        rest = [r for r in rows if r[0] > upto]
        held = self.bucket.get()
        z, last = (int(held[0]), held[1]) if held is not None else (None, None)
        if ready:
            us = np.array([r[0] for r in ready], np.int64)
            ok, retry, z = decide_in_order(us, self.clock, z, last)
            last = int(us[-1])
            if rest:
                self.waiting.put([(_packed(rest),)])
            else:
                self.waiting.clear()
            for (t, i), passes, wait in zip(ready, ok.tolist(), retry.tolist(), strict=True):
                yield Row(k=key[0], id=i, ts_s=t / 1e6, allowed=passes, retry_after=wait)
        gone = upto if last is None else last + self.clock.stale_us
        if gone < upto:
            if held is not None:
                self.bucket.clear()  # its next request would find a full bucket anyway
        elif ready:
            self.bucket.update((str(z), last))
        if rest:
            self.handle.registerTimer(_due(min(rest)[0]))
        elif last is not None and gone >= upto:
            self.handle.registerTimer(_due(gone) + 1)

    def close(self) -> None:
        pass


def _packed(rows: list[tuple[int, int]]) -> bytes:
    """(time, id) pairs as little-endian longs."""
    return np.array(rows, "<i8").tobytes()


def _unpacked(packed: bytes) -> list[tuple[int, int]]:
    return [(us, i) for us, i in np.frombuffer(packed, "<i8").reshape(-1, 2).tolist()]


def _due(us: int) -> int:
    """The first millisecond that is not before ``us``."""
    return -(-us // 1000)


def ordered_token_bucket_stream(events: DataFrame, key_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id",
                                rpm: float = catalog.DEFAULT_RPM, burst: int = catalog.DEFAULT_BURST,
                                stale_seconds: float = catalog.BUCKET_STALE_SECONDS, watermark: str = "1 hour") -> DataFrame:
    """Decisions ``(k, id, ts_s, allowed, retry_after)``, each once the watermark has passed its row."""
    src = (events.withColumn("__ts", F.col(ts_col).cast("timestamp")).withWatermark("__ts", watermark)
           .select(F.col(key_col).cast("string").alias("k"), F.col(id_col).cast("long").alias("id"), F.unix_micros("__ts").alias("us"), "__ts"))
    return src.groupBy("k").transformWithState(_Bucket(Clock(rpm, burst, stale_seconds)), OUT_SCHEMA, "Append", "EventTime")
