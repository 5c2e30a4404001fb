"""Out-of-order admission on a stream: decisions in event-time order, state that goes away."""

import datetime as dt
import random

from pyspark.sql import functions as F

import model
from veilspark.streaming import ordered_admission as O
from veilspark.streaming import runner

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "event_id long, ts timestamp, user_id long"


def _run(spark, batches, name, **how):
    path = runner.write_arrivals(spark, [spark.createDataFrame([(i, BASE + dt.timedelta(seconds=s), u) for i, s, u in b], SCHEMA) for b in batches], name)
    src = runner.file_stream(spark, path, spark.createDataFrame([], SCHEMA).schema)
    return runner.run_to_table(O.ordered_token_bucket_stream(src, **how), name, conf=O.STATE_STORE)


def test_shuffled_rows_are_decided_in_order_and_state_ends(spark):
    rnd = random.Random(21)
    rows = [(i, rnd.uniform(0, 20_000), rnd.choice([1, 1, 1, 2, 3, 4])) for i in range(1200)]
    rows += [(2000 + i, 5000.0, 1) for i in range(5)]  # equal times: by id
    by_arrival = sorted(rows, key=lambda r: r[1] + rnd.uniform(0, 3000))
    batches = [by_arrival[i:i + 300] for i in range(0, len(by_arrival), 300)]
    batches = [rnd.sample(b, len(b)) for b in batches]
    batches.append([(-1, 30_000, 99)])  # lets the last ones go; idle long enough to evict the others
    out = _run(spark, batches, "shuffled", rpm=2, burst=3, watermark="3000 seconds")
    got = {r.id: (r.allowed, r.retry_after) for r in out.collect()}
    want = model.token_bucket([(str(u), (BASE + dt.timedelta(seconds=s)).timestamp(), i) for i, s, u in rows], 2, 3)
    assert got == want and not all(a for a, _ in got.values())
    chk = out.inputFiles()[0].split("/out/")[0] + "/chk"
    for var in ("bucket", "waiting"):
        state = spark.read.format("statestore").option("path", chk).option("stateVarName", var).load()
        keys = {r.key.k for r in state.select("key").collect()}
        assert keys <= {"99"}, (var, keys)  # only the heartbeat's row still waits
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_quiet_key_starts_anew(spark):
    batches = [[(1, 0, 7), (2, 1, 7), (3, 2, 7)], [(4, 4000, 8)], [(5, 4001, 7), (6, 4002, 7), (7, 4003, 7)], [(-1, 20_000, 99)]]
    got = {r.id: r.allowed for r in _run(spark, batches, "quiet", rpm=1, burst=2, watermark="10 seconds").where(F.col("id") > 0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_rows_of_a_micro_batch_wait_as_one_entry(spark):
    """Each entry of list state is pickled, parsed and written by itself."""
    late = [(100 + i, 5000 + i, u) for u in (7, 8) for i in range(40)]
    out = _run(spark, [[(i, i, 7) for i in range(30)], late], "packed", rpm=60, burst=2, watermark="10 seconds")
    assert sorted(r.id for r in out.collect()) == sorted([*range(30), *(i for i, s, _ in late if s <= 5029)])
    chk = out.inputFiles()[0].split("/out/")[0] + "/chk"
    state = spark.read.format("statestore").option("path", chk).option("stateVarName", "waiting").load()
    assert sorted(r.key.k for r in state.select("key").collect()) == ["7", "8"]
