"""End-to-end redact / detect parity against the brute-force model."""

import model
from fixtures import FIXTURES
from pyspark.sql import functions as F

from veilspark.operators.detect import detect
from veilspark.operators.redact import redact


def _df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, context string")


def test_redact_fixtures_match_model(spark):
    rows = [(i, t, ctx) for i, (_n, ctx, t) in enumerate(FIXTURES)]
    out = redact(_df(spark, rows)).orderBy("doc_id").collect()
    assert len(out) == len(rows)
    for r in out:
        _name, ctx, text = FIXTURES[r.doc_id]
        clean, ok, actions, _err = model.sanitize(text)
        exp_text, exp_entries, nfc_text = model.redact(clean, ctx)
        assert r.is_valid == ok
        assert r.sanitization_actions == actions
        assert r.sanitized_text == exp_text, FIXTURES[r.doc_id][0]
        got = [e.asDict() for e in r.manifest.placeholders]
        assert got == exp_entries
        assert r.manifest.stats.entities_found == len(exp_entries)
        assert r.manifest.stats.text_length_original == len(nfc_text)
        assert r.manifest.stats.text_length_sanitized == len(exp_text)
        labels, score, sus = model.screen(clean)
        assert r.injection_patterns == labels and r.injection_score == score and r.injection_detected == sus
        assert r.output_warnings == model.audit(exp_text, exp_entries)
        assert r.manifest.redaction_id.startswith("red_") and len(r.manifest.redaction_id) == 12


def test_detect_fixtures_match_model(spark):
    rows = [(i, t, ctx) for i, (_n, ctx, t) in enumerate(FIXTURES)]
    out = detect(_df(spark, rows)).orderBy("doc_id").collect()
    for r in out:
        _name, ctx, text = FIXTURES[r.doc_id]
        exp = [(s["entity_type"], s["start"], s["end"], s["score"], s["text"]) for s in model.detect(text, ctx)]
        got = [(e.entity_type, e.start, e.end, e.score, e.text) for e in r.entities]
        assert got == exp, FIXTURES[r.doc_id][0]


def test_redact_real_documents_match_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", F.lit("general").alias("context"))
    out = redact(docs, envelope=False, keep_text=True).select("doc_id", "text", "sanitized_text", "is_valid").collect()
    src = {r.doc_id: r.text for r in docs.collect()}
    n_changed = 0
    for r in out:
        clean, ok, _a, _e = model.sanitize(src[r.doc_id])
        exp, _entries, _ = model.redact(clean, "general")
        assert r.sanitized_text == exp
        n_changed += exp != clean
    assert n_changed > 0
