"""Conversation-scope placeholders end to end vs the brute-force model."""

import unicodedata

import model

from veilspark.plans import q_reports
from veilspark.sources import tables

SF = "/root/testdata/sf0.001"


def _enrich(text, conv, turn, role):
    email = f"client{conv}@example.com"
    phone = f"(212) 555-{conv % 10000:04d}"
    tail = f" Reach me at {email}" if role == "user" else f" Noted: {email} and {phone}"
    return text + tail + f" Ref SSN {(conv * 7919 + turn) % 1000000000:09d}."


def test_conversation_redact_matches_model(spark):
    rows = tables.conversations(spark, SF).collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r.conv_id, []).append(r)
    expected = {}
    for conv, turns in by_conv.items():
        seen, counters = {}, {}
        for r in sorted(turns, key=lambda x: x.turn):
            text = unicodedata.normalize("NFC", _enrich(r.text, conv, r.turn, r.role))
            spans = sorted(model.detect(text, "general"), key=lambda s: s["start"])
            out = text
            for s in spans:
                if s["text"] not in seen:
                    counters[s["entity_type"]] = counters.get(s["entity_type"], 0) + 1
                    seen[s["text"]] = f"<{s['entity_type']}_{counters[s['entity_type']]}>"
            for s in reversed(spans):
                out = out[: s["start"]] + seen[s["text"]] + out[s["end"]:]
            expected[(conv, r.turn)] = out
    got = {(r.conv_id, r.turn): r.sanitized_text for r in q_reports.conversation_redact(spark, SF).collect()}
    assert got == expected
    assert any("<EMAIL_1>" in v for v in got.values())
