"""Spans of plain rows come from Arrow's regex kernels, those of all others from Java: the same ones."""

import itertools

import pytest
from fixtures import FIXTURES
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import marks
from veilspark.functions import spans as S
from veilspark.operators import detect as D

RECOGNISERS = [D._recogniser_pattern(p) for p in catalog.LAYER3_PATTERNS]


def _texts() -> list[str | None]:
    parcels = [f"{lead} {'A' * n}{mid}{tail}" for lead in ("APN:", "tax id #", "Parcel no.") for n in (3, 4, 5, 23, 24, 25, 26)
               for mid, tail in itertools.product(("", ".", "-", "/", "-9", "_"), ("", " x", "_", ". APN 123456", "-B1", "\n"))]
    streets = [f"{n} {' '.join(['Oak'] * k)} {kind}{end}" for n in ("7", "123456") for k in range(5) for kind in ("St", "Stone", "Lane", "Way.")
               for end in ("", " Apt 4", " # 12 x", "  suite", "\tUnit\n9")]
    base = [t for _, _, t in FIXTURES]
    odd = [f"{t[:60]}{c}{t[60:]}" for t in base for c in ("\x01", "\x0b", "\x0c", "\x1c", "é", "ſ", "K", "\r\n", "\x00")]
    joins = [a + s + b for a, b in itertools.product(("SSN 219-09-9999", "acct # 00123456", "seed phrase: 'a b'", "DOB: 1984-07-12", "x@y.co"), repeat=2)
             for s in ("", " ", "\n", "-", "_", "1", ".")]
    return [*base, *odd, *parcels, *streets, *joins, *(t.lower() for t in base), *(t.upper() for t in base), "", None]


@pytest.mark.parametrize("patterns", [list(catalog.LAYER1_PATTERNS), RECOGNISERS])
def test_arrow_and_java_find_the_same_spans(spark, monkeypatch, patterns):
    df = spark.createDataFrame(list(enumerate(_texts())), "id int, text string").repartition(4).cache()
    find = lambda: {r.id: r.sp for r in S.with_pattern_spans(df, "text", patterns, "sp", raw=True).collect()}
    arrow = find()
    with monkeypatch.context() as m:
        m.setattr(marks, "plain", lambda text: F.lit(False))
        java = find()
    assert arrow == java and sum(len(x) for x in arrow.values()) > 100


def test_every_catalogue_pattern_has_a_form_and_odd_syntax_has_none():
    assert all(marks.re2_marks(p.regex, p.group) for p in [*catalog.LAYER1_PATTERNS, *RECOGNISERS])
    for odd in (r"^a", r"a$", r"(?=a)b", r"a++", r"(?:a|b*)*c", r"\x41", r"\p{L}", r"a{,3}", r"[a[:x]]", r"[a&&b]", "é", r"(?x)a b", r"\Aa"):
        assert marks.re2_marks(odd, 0) is None, odd


def test_plain_rows_are_not_searched_by_java(spark):
    df = spark.createDataFrame([("SSN 219-09-9999",), ("é 219-09-9999",)], "text string")
    kinds = S.with_pattern_spans(df, "text", list(catalog.LAYER1_PATTERNS), "sp", raw=True)
    assert "ArrowEvalPython" in kinds._jdf.queryExecution().executedPlan().toString()
    assert [[s.text for s in r.sp] for r in kinds.orderBy("text").collect()] == [["219-09-9999"], ["219-09-9999"]]


def test_a_users_pattern_beyond_re2_stays_with_java(spark):
    own = [catalog.SpanPattern("A", r"(?<=x)\d+", 0.5), catalog.SpanPattern("B", r"y(\d+)", 0.6, 1)]
    df = spark.createDataFrame([("x12 y34 x5",), ("x1 é y2",), (None,)], "text string")
    got = [[(s.entity_type, s.start, s.end, s.text, s.ord) for s in r.sp] for r in S.with_pattern_spans(df, "text", own, "sp", raw=True).collect()]
    assert [sorted(x) for x in got] == [[("A", 1, 3, "12", 0), ("A", 9, 10, "5", 0), ("B", 5, 7, "34", 1)], [("A", 1, 2, "1", 0), ("B", 6, 7, "2", 1)], []]
