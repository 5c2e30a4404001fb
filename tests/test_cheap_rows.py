"""Rows skip the work that cannot change them, with the same results."""

import regex

from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import spans as S
from veilspark.operators import sanitize as Z
from veilspark.operators.normalize import nfc
from veilspark.operators.redact import number_spans
from veilspark.streaming.runner import settings

# a literal without its pattern, patterns at the edges, white space and letters beyond ASCII
TEXTS = ["", "plain", "a < b and c > d", "<b>x</b>", "<SCRIPT>1</script>\n\n\n\n\nend", "<ſcript>x</ſcript>", "![a](https://x.y/z)!",
         "![a](ftp://x)", "a" + " " * 12 + "b", "a" + " " * 12 + "b", " " * 10, "\t" * 9, "\n\n\n", "\n\n\n\n", "​z​",
         "A" * 200, "é" + "A" * 200, "一" + "A" * 250 + "==", "_" + "A" * 220, "x\x00\x7fy <i\x01>", "[" + "q1" * 120 + "=]", None]


def test_sanitiser_behind_its_tests_equals_every_rewrite(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").coalesce(1)
    every = F.col("text")
    for _, rewrites in Z.steps():
        for rx, rep in rewrites:
            every = F.regexp_replace(every, rx, rep)
    got = {r["id"]: r["text"] for r in Z.sanitize(df, "text").collect()}
    assert got == {r["id"]: r["e"] for r in df.select("id", every.alias("e")).collect()}


def _plan(df) -> str:
    with settings(df.sparkSession, {"spark.sql.debug.maxToStringFields": "10000"}):
        return df._jdf.queryExecution().analyzed().toString()


def test_rewrites_and_nfc_are_behind_cheap_tests(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    assert _plan(Z.sanitize(df, "text")).lower().count("contains(") >= 4
    assert "octet_length(" in _plan(df.select(nfc(F.col("text"))))


def _spans(n):
    """``n`` spans in islands of one to five, with equal starts and scores among them."""
    return [(3 * i + (i % 5 == 0) * 40 * (i // 5), -float(i % 3), 0, i, 3 * i + (i % 5 == 0) * 40 * (i // 5) + 1 + i * 7 % 11,
             f"T{i % 4}", float(i % 3), f"v{i % 6}") for i in range(n)]


def test_fold_at_once_equals_fold_by_island(spark, monkeypatch):
    rows = [(n, _spans(n)) for n in (0, 1, 2, 7, 20, S.FEW_SPANS, S.FEW_SPANS + 1)]
    df = spark.createDataFrame(rows, f"id int, sp {S.T.ArrayType(S.SPAN_TYPE).simpleString()}").coalesce(1)
    got = df.select("id", S.merge_fold(S.sort_spans(F.col("sp"))).alias("m")).collect()
    monkeypatch.setattr(S, "FEW_SPANS", 0)
    assert got == df.select("id", S.merge_fold(S.sort_spans(F.col("sp"))).alias("m")).collect()


def test_sorts_and_unmatched_patterns_take_no_interpreted_work(spark):
    df = spark.createDataFrame([(1, "mail a@b.example, SSN 123-45-6789")], "id int, text string")
    many = S.with_layer1_spans(df, "text", "sp")
    # one expression looks at the patterns that match, instead of one for each pattern
    plan = _plan(many)
    assert plan.count("substring(text") == 2
    plan = _plan(many.select(number_spans(S.merge_fold(S.sort_spans(F.col("sp")))).alias("e")))
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_matches_keep_catalogue_order_and_offsets(spark):
    text = "SSN 123-45-6789, 987-65-4321; a@b.example; é 111-22-3333"
    got = spark.createDataFrame([(text,), (None,), ("none",)], "text string").coalesce(1)
    rows = S.with_layer1_spans(got, "text", "sp").collect()
    want = []
    for i, p in enumerate(catalog.LAYER1_PATTERNS):
        for m in regex.finditer(p.regex, text):
            want.append((i, m.start(p.group), m.end(p.group), p.entity_type, p.score, m.group(p.group)))
    assert [(s["ord"], s["start"], s["end"], s["entity_type"], s["score"], s["text"]) for s in rows[0]["sp"]] == want
    assert all(s["nscore"] == -s["score"] and s["source"] == 0 for s in rows[0]["sp"])
    assert rows[1]["sp"] == [] and rows[2]["sp"] == []
