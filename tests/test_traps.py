"""Documented edge behaviours (built to the specified code, kept as tests)."""

import model
from pyspark.sql import functions as F

from veilspark.functions import spans as S
from veilspark.operators.detect import detect
from veilspark.operators.redact import redact


def _detect(spark, text, ctx="general"):
    df = spark.createDataFrame([(0, text, ctx)], "doc_id long, text string, context string")
    return [(e.entity_type, e.text) for e in detect(df).collect()[0].entities]


def test_fold_drops_disjoint_span(spark):
    # A[0,10) .70, B[5,20) .90, C[15,25) .95 -> only C survives
    spans = F.array(
        S.make_span("A", F.lit(0), F.lit(10), 0.70, F.lit("a"), 0, 0),
        S.make_span("B", F.lit(5), F.lit(20), 0.90, F.lit("b"), 0, 1),
        S.make_span("C", F.lit(15), F.lit(25), 0.95, F.lit("c"), 0, 2))
    got = spark.range(1).select(S.merge_fold(S.sort_spans(spans)).alias("m")).collect()[0].m
    assert [x.entity_type for x in got] == ["C"]


def test_ssn_swallows_routing_number(spark):
    got = _detect(spark, "routing number: 021000021")
    assert got == [("US_SSN", "021000021")]


def test_phone_keeps_leading_paren(spark):
    assert ("US_PHONE", "610) 555-1234") in _detect(spark, "call (610) 555-1234 now")


def test_parcel_before_full_stop_is_missed(spark):
    got = _detect(spark, "Parcel 12-345-678. Next")
    assert not any(t == "PARCEL_NUMBER" for t, _ in got)
    assert ("PARCEL_NUMBER", "12-345-678") in _detect(spark, "Parcel 12-345-678 next")


def test_allow_listed_winner(spark):
    assert _detect(spark, "password=2025") == []          # value fully matches a year
    assert _detect(spark, "client_id: 2045") == []


def test_prose_false_positives(spark):
    got = dict((t, v) for t, v in _detect(spark, "Title commitment ok. The loan originator called."))
    assert got.get("FILE_REFERENCE") == "commitment" and got.get("LOAN_NUMBER") == "originator"


def test_html_stripping_eats_angle_data(spark):
    df = spark.createDataFrame([(0, "mail <john@x.com> or <PERSON_1>", "general")],
                               "doc_id long, text string, context string")
    r = redact(df).collect()[0]
    assert r.sanitized_text == "mail  or " and r.manifest.stats.entities_found == 0


def test_repeat_reuses_first_placeholder_across_types(spark):
    text = "acct 12345678 and later 12345678"
    df = spark.createDataFrame([(0, text, "tax_return")], "doc_id long, text string, context string")
    r = redact(df, envelope=False).collect()[0]
    exp_text, exp_entries, _ = model.redact(text, "tax_return")
    assert r.sanitized_text == exp_text
    assert [e.asDict() for e in r.manifest.placeholders] == exp_entries


def test_case_variants_get_distinct_placeholders(spark):
    text = "John@X.com and john@x.com"
    df = spark.createDataFrame([(0, text, "general")], "doc_id long, text string, context string")
    r = redact(df, envelope=False).collect()[0]
    assert r.sanitized_text == "<EMAIL_1> and <EMAIL_2>"


def test_injection_plain_system_and_dan_below_threshold(spark):
    from veilspark.operators.screen import screen
    df = spark.createDataFrame([(0, "the system"), (1, "Dan")], "id long, text string")
    out = {r.id: (r.injection_score, r.injection_detected) for r in screen(df, "text").collect()}
    assert out == {0: (0.65, False), 1: (0.6, False)}


def test_offsets_cut_the_text(spark):
    text = "🙂 é x 555-123-4567 y ana@b.co"
    df = spark.createDataFrame([(0, text, "general")], "doc_id long, text string, context string")
    for e in detect(df).collect()[0].entities:
        assert text[e.start:e.end] == e.text


def test_allow_terms_and_context_filter_on_model_spans(spark):
    from veilspark.operators import detect as D
    text = "Roth IRA for Maria Lopez via HOA"
    ext = [("PERSON", 0, 4, 0.85), ("PERSON", 13, 24, 0.85), ("ORGANIZATION", 29, 32, 0.9), ("NRP", 13, 18, 0.5)]
    df = spark.createDataFrame([(0, text, "general", ext)],
                               "doc_id long, text string, context string, "
                               "ext array<struct<entity_type:string,start:int,end:int,score:double>>")
    out = D.detect(df, external_col="ext").collect()[0].entities
    # "Roth" is an allow term, ORGANIZATION/NRP are not requested in the general context
    assert [(e.entity_type, e.text) for e in out] == [("PERSON", "Maria Lopez")]


def test_user_supplied_context_table(spark):
    from veilspark.operators import detect as D
    text = "Policy # AB123456 and account ending in 4321"
    df = spark.createDataFrame([(0, text, "general")], "doc_id long, text string, context string")
    default = [e.entity_type for e in D.detect(df).collect()[0].entities]
    custom = [e.entity_type for e in D.detect(df, contexts={"general": ("POLICY_NUMBER", "ACCOUNT_REF")})
              .collect()[0].entities]
    assert "POLICY_NUMBER" not in default and "POLICY_NUMBER" in custom and "ACCOUNT_REF" in custom
