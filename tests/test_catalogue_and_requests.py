"""User catalogues are validated; request files keep what they cannot read."""

import json

import pytest
import regex

from veilspark import catalog
from veilspark.functions import dialect
from veilspark.sources import tables


def test_built_in_patterns_pass_validation():
    for p in (*catalog.LAYER1_PATTERNS, *catalog.LAYER3_PATTERNS):
        dialect.validate(p.regex, p.group)


@pytest.mark.parametrize(("pattern", "group"), [(r"(a)\1", 0), (r"(?P<x>a)(?P=x)", 0), (r"k:(\d)+", 1), (r"k:(\d){2}", 1), (r"k:(\d)?", 1)])
def test_patterns_that_the_rewrite_would_change_are_refused(pattern, group):
    with pytest.raises(ValueError):
        dialect.validate(pattern, group)


def test_broken_patterns_are_refused():
    with pytest.raises(regex.error):
        dialect.validate("(a", 0)
    dialect.validate(r"k:(\d+)", 1)
    dialect.validate(r"\\1 (a)", 1)


def test_request_files_and_quarantine(spark, tmp_path):
    good = [{"doc_id": 1, "text": "a", "context": "general"}, {"doc_id": 2, "text": "b"}]
    bad = ['{"doc_id": 3, "text": ', "nonsense", json.dumps({"doc_id": 4}), json.dumps({"doc_id": 5, "text": "c", "context": "no such"}),
           json.dumps({"doc_id": 6, "text": "d" * 50})]
    (tmp_path / "r.json").write_text("\n".join([*map(json.dumps, good), *bad]))
    df = tables.read_requests(spark, str(tmp_path / "r.json")).cache()
    ok, out = tables.split_requests(df, max_chars=20)
    assert sorted((r.doc_id, r.text) for r in ok.collect()) == [(1, "a"), (2, "b")] and ok.columns == ["doc_id", "text", "context"]
    got = sorted((r.reject_reason, r[tables.CORRUPT]) for r in out.collect() if r[tables.CORRUPT])
    assert got == [("malformed_record", "nonsense"), ("malformed_record", bad[0])]
    assert sorted(r.reject_reason for r in out.collect()) == ["malformed_record", "malformed_record", "missing_text", "text_too_long", "unknown_context"]
    assert tables.split_requests(df, max_chars=None)[0].count() == 3


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    got = tables.read_text_files(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["one\ntwo", "three"] and len({r.doc_id for r in got}) == 2
