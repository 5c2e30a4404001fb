"""Queries over all notes do their work once, in enough parts, and shuffle the hits only."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.operators import gazetteer, sinks
from veilspark.plans import q_reports
from veilspark.sources import tables


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame([(k, 1 + k % 2, "1-URGENT", 100.5 + k) for k in range(1, 41)], "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double") \
        .withColumn("o_orderdate", F.expr("timestamp_ntz '1995-03-01 00:00:00'")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer#1", 0, "MACHINERY"), (2, "Customer#2", 0, "FURNITURE")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string") \
        .write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "FRANCE", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "EUROPE")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    return str(tmp_path)


def test_buckets_follow_the_session(spark, small, monkeypatch):
    made, write = [], sinks.write_bucketed
    monkeypatch.setattr(sinks, "write_bucketed", lambda df, table, path, buckets, id_col: (made.append(buckets), write(df, table, path, buckets, id_col)))
    out = entry.queries()["rehydrate_copartitioned"](spark, small)
    assert made == [tables.tasks(spark)] * 2 and made[0] > 8
    assert out.where("rehydrated_text IS NOT NULL").count() == 40
    after = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(note_id", after)


def test_sketches_and_exact_counts_read_one_detection(spark, small, monkeypatch):
    runs, detect = [], q_reports.D.detect_spans
    monkeypatch.setattr(q_reports.D, "detect_spans", lambda *a, **k: (runs.append(1), detect(*a, **k))[1])
    out = entry.queries()["sketched_values"](spark, small)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(runs) == 1 and "EvalPython" not in plan and "regexp_replace" not in plan
    rows = out.collect()
    assert rows and all(r.distinct_within and r.top_within for r in rows)


def test_many_numbers_leave_few_word_windows(spark, monkeypatch):
    """More terms than the bitmaps have bits: windows of another shape still go."""
    terms = spark.range(400_000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 997, F.col("id") % 89, F.col("id") % 9973).alias("term"),
                                        F.lit("US_SSN").alias("entity_type"), F.lit(1.0).alias("score"))
    text = "paid 12 of 345 on 2024 05 17 and 6789012 for 1 or 22 with 333 but 4444 then 996 88 9972 and 001-01-0001, 77 " * 5
    docs = spark.createDataFrame([(1, text), (2, "é " + text), (3, None)], "doc_id long, text string")
    formed, explode = [], gazetteer.explode_rows
    monkeypatch.setattr(gazetteer, "explode_rows", lambda df, *a: (formed.append(df.select(F.sum(F.size("grams"))).first()[0]), explode(df, *a))[1])
    got = gazetteer.dictionary_spans(docs, terms, key=b"k").where("doc_id < 3").orderBy("doc_id", "start").collect()
    known = {r.term for r in terms.collect()}
    want = sorted((d, m.start(), m.end()) for d, t in ((1, text), (2, "é " + text)) for m in re.finditer(r"(?=\b(\d{3})\W+(\d{2})\W+(\d{4})\b)", t)
                  for m in [re.compile(r"\d{3}\W+\d{2}\W+\d{4}").match(t, m.start())] if "-".join(re.findall(r"\d+", m.group())) in known)
    assert [(r.doc_id, r.start, r.end) for r in got] == want and want
    assert formed[0] < 40
