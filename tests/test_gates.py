"""Gated span extraction must equal ungated extraction."""

from fixtures import FIXTURES
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import dialect
from veilspark.functions import spans as S
from veilspark.sources import notes as N

TRAPS = [
    "ſecret=ABCDEFGHIJKLMNOP and pasſword=xyz123",          # long s folds onto s
    "ACKOUNT 1234567 and Kelvin acKount 12345678",           # Kelvin sign folds onto k
    "İD: tenant_İd=0123456789abcdef0123 MİN 123456789012345678",
    "nothing to see here",
    "EYJABC.EYJDEF.GHI eyJabc.eyJdef.ghi",
]


def _spans(df, gated):
    pats = list(catalog.LAYER1_PATTERNS) + list(catalog.LAYER3_PATTERNS)
    out = S.with_pattern_spans(df, "text", pats, "sp", raw=True, gated=gated)
    return {r.doc_id: [tuple(x) for x in r.sp] for r in out.select("doc_id", "sp").collect()}


def test_gates_do_not_change_spans(spark):
    rows = [(i, t) for i, (_n, _c, t) in enumerate(FIXTURES)] + [(100 + i, t) for i, t in enumerate(TRAPS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _spans(df, True) == _spans(df, False)


def test_gates_on_notes(spark):
    n = N.notes(spark, "/root/testdata/sf0.001").select(F.col("note_id").alias("doc_id"), "text")
    assert _spans(n, True) == _spans(n, False)


def test_ascii_rows_are_matched_without_the_unicode_flag(spark, monkeypatch):
    pats = list(catalog.LAYER1_PATTERNS) + list(catalog.LAYER3_PATTERNS)
    java = [dialect.three_group_java(p.regex, p.group) for p in pats]
    assert all(dialect.ascii_java(j, p.regex).startswith("(?d") for j, p in zip(java, pats, strict=True))
    # a pattern that names other characters keeps the flag on every row
    assert [dialect.ascii_java("(?Ud)()(x)()", x) for x in ("caf\u00e9", r"\x{e9}", r"\u00e9", r"\p{L}+")] == [None] * 4
    # every ASCII character beside and inside values, and the same rows made non-ASCII
    rows = [t for _n, _c, t in FIXTURES] + TRAPS + [f"{chr(c)}219-09-9999{chr(c)} a{chr(c)}b@x.com SSN{chr(c)}219-09-9999" for c in range(1, 128)]
    df = spark.createDataFrame([*enumerate(rows + [t + " \u00e9" for t in rows] + [None])], "doc_id long, text string")
    got = _spans(df, True)
    monkeypatch.setattr(dialect, "ascii_java", lambda java, pattern: None)
    assert got == _spans(df, True) and sum(map(len, got.values())) > 200
