"""Work on derived notes and on map-only streams uses every task slot."""

import datetime as dt

from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import gates
from veilspark.functions import spans as S
from veilspark.plans import q_admission
from veilspark.sources import notes as N
from veilspark.streaming import runner


def _tables(spark, sf, n=60):
    spark.createDataFrame([(0, "ICELAND", 0)], "n_nationkey int, n_name string, n_regionkey int").coalesce(1).write.parquet(f"{sf}/nation.parquet")
    spark.createDataFrame([(0, "EUROPE")], "r_regionkey int, r_name string").coalesce(1).write.parquet(f"{sf}/region.parquet")
    seg = list(N.SEGMENT_TEMPLATES)
    spark.createDataFrame([(i, f"Customer#{i}", 0, seg[i % 5]) for i in range(10)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string") \
        .coalesce(1).write.parquet(f"{sf}/customer.parquet")
    pri = list(N.PRIORITY_TEMPLATES)
    spark.createDataFrame([(i, i % 10, pri[i % 5], dt.datetime(2024, 1, 1 + i % 28), 100.0 + i) for i in range(n)],
                          "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double") \
        .coalesce(1).write.parquet(f"{sf}/orders.parquet")


def test_notes_of_one_file_are_dealt_out(spark, tmp_path):
    _tables(spark, str(tmp_path))
    notes = N.notes(spark, str(tmp_path))
    dealt = notes.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in dealt) == 60
    assert len(dealt) >= spark.sparkContext.defaultParallelism
    # dealt out by the note's id, so grouping by it moves no texts
    plan = notes.groupBy("note_id").agg(F.max("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(o_orderkey") == 1 and "hashpartitioning(note_id" not in plan


def test_map_only_streams_take_files_for_all_tasks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"Reach a{i}@example.com", "en", "x", 20) for i in range(6)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    taken, real = [], runner.file_stream

    def file_stream(spark, path_glob, schema, max_files=1):
        taken.append(max_files)
        return real(spark, path_glob, schema, max_files)

    monkeypatch.setattr(runner, "file_stream", file_stream)
    out = {r.doc_id: r.sanitized_text for r in q_admission.redact_stream(spark, str(tmp_path)).collect()}
    assert out == {i: "Reach <EMAIL_1>" for i in range(6)}
    assert taken and min(taken) >= spark.sparkContext.defaultParallelism


def test_digit_led_patterns_are_led_by_their_first_characters(spark):
    led = [p for p in catalog.LAYER1_PATTERNS if p.entity_type in ("CREDIT_CARD", "US_SSN", "EIN", "US_PHONE", "STREET_ADDRESS")]
    assert len(led) == 5 and all(gates.lookahead(p) for p in led)
    texts = ["Call +1 (212) 555-0100 or (212)555.0100, 1-800-555-0110", "x219-09-9999 219-09-9999 ١٢٣-٤٥-٦٧٨٩", "4111 1111 1111 1111, 12-3456789",
             "at 12 Main St. and ٧ Harbor View Lane", "a\u0001219-09-9999\u0002 12 Oak Ave"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = [{r.doc_id: r.sp for r in S.with_pattern_spans(df, "text", led, "sp", raw=True, gated=g).collect()} for g in (True, False)]
    assert got[0] == got[1] and sum(map(len, got[0].values())) >= 9
    for i, t in enumerate(texts):
        assert all(t[s.start:s.end] == s.text for s in got[0][i])
