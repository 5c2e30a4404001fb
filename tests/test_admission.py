"""Token bucket: batch and stream against the brute-force fold."""

import datetime as dt

import model

from veilspark.operators import admission
from veilspark.sources import tables

SF = "/root/testdata/sf0.001"


def _expected(rows, rpm, burst, stale=1800.0):
    ev = [(str(u), ts.replace(tzinfo=dt.timezone.utc).timestamp(), i) for i, ts, u in rows]
    return model.token_bucket(ev, rpm, burst, stale)


def test_batch_matches_model_on_events(spark):
    ev = tables.events(spark, SF)
    rows = [(r.event_id, r.ts, r.user_id) for r in ev.collect()]
    for rpm, burst in [(1.0 / 60.0, 2), (60, 10), (0.5, 1)]:
        out = admission.token_bucket(ev, "user_id", "ts", "event_id", rpm=rpm, burst=burst).collect()
        exp = _expected(rows, rpm, burst)
        got = {r.id: (r.allowed, r.retry_after) for r in out}
        assert got == exp
        if rpm < 1:
            assert any(not a for a, _ in got.values())


def test_hand_case(spark):
    base = dt.datetime(2024, 1, 1)
    evs = [(1, base, 7), (2, base + dt.timedelta(seconds=1), 7), (3, base + dt.timedelta(seconds=2), 7),
           (4, base + dt.timedelta(seconds=3), 8), (5, base + dt.timedelta(seconds=62), 7),
           (6, base + dt.timedelta(hours=2), 7)]
    df = spark.createDataFrame(evs, "event_id long, ts timestamp_ntz, user_id long")
    got = {r.id: (r.allowed, r.retry_after) for r in
           admission.token_bucket(df, "user_id", "ts", "event_id", rpm=1, burst=2).collect()}
    # burst 2: first two pass, third waits; a minute refills one token
    assert got[1] == (True, 0.0) and got[2] == (True, 0.0)
    assert got[3] == (False, 58.0)
    assert got[4] == (True, 0.0) and got[5] == (True, 0.0) and got[6] == (True, 0.0)


def test_stream_equals_batch(spark):
    from veilspark.plans import q_admission
    b = {r.event_id: (r.allowed, r.retry_after) for r in q_admission.token_bucket(spark, SF).collect()}
    s = {r.event_id: (r.allowed, r.retry_after) for r in q_admission.token_bucket_stream(spark, SF).collect()}
    assert b == s


def test_hot_key_split_across_partitions(spark):
    import random
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(3000):                      # one key holds most of the events
        t += rnd.choice([0.2, 0.5, 1.0, 3.0, 40.0, 2000.0])
        rows.append((i, base + dt.timedelta(seconds=t), 1))
    for i in range(3000, 3600):
        rows.append((i, base + dt.timedelta(seconds=rnd.uniform(0, t)), rnd.randint(2, 9)))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
    for rpm, burst in [(60, 3), (6, 2)]:
        got = {r.id: (r.allowed, r.retry_after) for r in
               admission.token_bucket(df, "user_id", "ts", "event_id", rpm=rpm, burst=burst, partitions=16).collect()}
        assert got == _expected(rows, rpm, burst)
    seg = admission.with_segments(df, "user_id", "ts", "event_id", 60, 3, partitions=16)
    assert seg.filter("k = '1'").select("seg").distinct().count() > 1


# ------------------------------------------------------------- state maps
def _exit(times, z, clock):
    for t in times:
        if z <= t + clock.slack:
            z = max(z, t) + clock.cost
    return z


def test_state_map_tells_every_entry_state():
    """Small whole numbers: every entry state of many random slices, and of slices put together."""
    import random
    rnd = random.Random(11)
    for _ in range(400):
        clock = admission.Clock(1, 1, 0)
        clock.tick, clock.cost = 1, rnd.randint(1, 9)
        burst = rnd.randint(1, 6)
        clock.full, clock.slack = burst * clock.cost, (burst - 1) * clock.cost
        gaps = rnd.choice([(0, 1, 2), (0, 3), (0, 1, 9, 20), (2, 5, 7), (0, 0, 0, 1), (4, 40)])
        times = [5]
        for _ in range(rnd.randint(0, 60)):
            times.append(times[-1] + rnd.choice(gaps))
        pieces = admission.state_map(times, clock)
        assert len(pieces) <= 4 * burst + 8
        for z in range(times[0], times[0] + clock.full + 1):
            assert admission.follow(pieces, z, clock.cost) == _exit(times, z, clock), (times, z, clock.cost, burst)


def test_a_key_that_is_never_idle_runs_on_all_tasks(spark):
    """Half of the requests are of one overloaded key without a pause: every task decides its own slice."""
    import random

    from pyspark.sql import functions as F
    rnd = random.Random(12)
    base = dt.datetime(2024, 1, 1)
    for mean, rpm, burst in ((0.05, 60, 10), (1.0, 60, 10), (0.9, 61, 3), (0.5, 60, 1), (1.3, 50, 40)):
        rows, t = [], 0.0
        for i in range(8000):
            t += rnd.expovariate(1 / mean)
            rows.append((i, base + dt.timedelta(microseconds=round(t * 1e6)), 1))
        rows += [(i, base + dt.timedelta(microseconds=rnd.randint(0, round(t * 1e6))), rnd.randint(2, 900)) for i in range(8000, 12000)]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long")
        got = admission.token_bucket(df, rpm=rpm, burst=burst, partitions=12).withColumn("task", F.spark_partition_id()).collect()
        assert {r.id: (r.allowed, r.retry_after) for r in got} == _expected(rows, rpm, burst)
        share = [sum(1 for r in got if r.task == p) for p in range(12)]
        assert max(share) < 2 * 12000 / 12 and len({r.task for r in got if r.k == "1"}) >= 7


def test_ties_numbers_nulls_and_large_values(spark):
    rows = [(1, 5.0, "a"), (2, 5.0, "a"), (3, 5.0, "a"), (4, None, "a"), (5, 6.0, None), (6, 1e9, "a"), (7, 1e9 + 0.4, "a"), (8, -3.5, "b")]
    df = spark.createDataFrame(rows, "event_id long, ts double, user_id string")
    got = {r.id: (r.allowed, r.retry_after) for r in admission.token_bucket(df, rpm=60, burst=2).collect()}
    assert got == {1: (True, 0.0), 2: (True, 0.0), 3: (False, 1.0), 4: (None, None), 5: (True, 0.0), 6: (True, 0.0), 7: (True, 0.0), 8: (True, 0.0)}
    assert admission.token_bucket(df.limit(0), rpm=60, burst=2).count() == 0
    huge = admission.token_bucket(df.where("ts is not null"), rpm=59.999999, burst=10**6, stale_seconds=1e12)
    assert all(r.allowed for r in huge.collect())
