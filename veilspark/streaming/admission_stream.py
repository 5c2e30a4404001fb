"""Token-bucket admission on a stream (T1-T3 with Structured Streaming state).

State per key: ``(tokens, last_ts)``.  Each micro-batch's requests for a key
are folded in event-time order; an event-time timeout set to ``last_ts +
stale_seconds`` evicts idle keys once the watermark passes it, which is the
eviction rule of the batch operator (state TTL), so keys that go quiet do
not accumulate in the state store.

A row older than what its key's state has seen already comes out as ``late``
with null decisions and does not touch the state: time never runs backwards.
(Rows older than the watermark never reach the operator.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import catalog

OUT_SCHEMA = "k string, id long, ts_s double, allowed boolean, retry_after double, late boolean"
STATE_SCHEMA = "tokens double, last_ts double"


def token_bucket_stream(events: DataFrame, key_col: str = "user_id", ts_col: str = "ts", id_col: str = "event_id",
                        rpm: float = catalog.DEFAULT_RPM, burst: int = catalog.DEFAULT_BURST,
                        stale_seconds: float = catalog.BUCKET_STALE_SECONDS,
                        watermark: str = "1 hour") -> DataFrame:
    rate = rpm / 60.0
    src = (events.withColumn("__ts", F.col(ts_col).cast("timestamp")).withWatermark("__ts", watermark)
           .select(F.col(key_col).cast("string").alias("k"), F.col(id_col).cast("long").alias("id"),
                   (F.unix_micros("__ts") / 1e6).alias("ts_s"), "__ts"))

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"k": pd.Series([], dtype=object), "id": pd.Series([], dtype="int64"),
                                "ts_s": pd.Series([], dtype="float64"), "allowed": pd.Series([], dtype=bool),
                                "retry_after": pd.Series([], dtype="float64"), "late": pd.Series([], dtype=bool)})
            return
        # one key's rows of one micro-batch (bounded by the trigger size)
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts_s", "id"], kind="stable")
        tokens, last = (state.get if state.exists else (None, None))
        late = pdf["ts_s"] < (last if last is not None else float("-inf"))
        behind, pdf = pdf[late], pdf[~late]
        if len(behind):
            yield pd.DataFrame({"k": key[0], "id": behind["id"].to_numpy(), "ts_s": behind["ts_s"].to_numpy(),
                                "allowed": None, "retry_after": None, "late": True})
        allowed, retry = [], []
        for t in pdf["ts_s"].to_numpy():
            if tokens is None or t - last > stale_seconds:
                tokens, last = float(burst), t
            tokens = min(float(burst), tokens + (t - last) * rate)
            last = t
            if tokens >= 1.0:
                tokens -= 1.0
                allowed.append(True)
                retry.append(0.0)
            else:
                allowed.append(False)
                retry.append(round((1.0 - tokens) / rate, 1))
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + stale_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        if len(pdf):
            yield pd.DataFrame({"k": key[0], "id": pdf["id"].to_numpy(), "ts_s": pdf["ts_s"].to_numpy(),
                                "allowed": allowed, "retry_after": retry, "late": False})

    return src.groupBy("k").applyInPandasWithState(
        fn, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
