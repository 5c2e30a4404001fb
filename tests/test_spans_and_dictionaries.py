"""Best sets of spans, large islands, dictionaries behind bitmaps, leaks across rows, context words as arguments."""

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from veilspark.catalog import SpanPattern
from veilspark.functions import spans as S
from veilspark.operators import audit
from veilspark.operators import detect as D
from veilspark.operators.gazetteer import dictionary_spans


def _rows(spark, cases):
    """``[(start, end, score)]`` per row -> a column of sorted spans."""
    df = spark.createDataFrame([(i, [(a, b, float(s)) for a, b, s in c]) for i, c in enumerate(cases)], "id int, c array<struct<a:int,b:int,s:double>>")
    sp = F.transform("c", lambda x, i: S.make_span(F.lit("T"), x["a"], x["b"], x["s"], F.lit("x"), 0, i))
    return df.select("id", S.sort_spans(sp).alias("sp"))


def test_best_sets_equal_all_subsets(spark):
    rnd = random.Random(6)
    cases = [[(0, 10, 0.7), (5, 20, 0.9), (15, 25, 0.95)], []]
    for _ in range(150):
        c = []
        for _ in range(rnd.randint(1, 7)):
            a = rnd.randint(0, 20)
            c.append((a, a + rnd.randint(1, 9), rnd.choice([0.5, 0.7, 0.85, 0.9])))
        cases.append(c)
    got = {r.id: r.m for r in _rows(spark, cases).select("id", S.merge_best(F.col("sp")).alias("m")).collect()}
    for i, c in enumerate(cases):
        best = (0.0, 0)
        for k in range(len(c) + 1):
            for some in itertools.combinations(c, k):
                if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(some, 2)):
                    best = max(best, (round(sum(x[2] for x in some), 9), sum(x[1] - x[0] for x in some)))
        kept = [(s.start, s.end, s.score) for s in got[i]]
        assert (round(sum(x[2] for x in kept), 9), sum(x[1] - x[0] for x in kept)) == best and kept == sorted(kept), c
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(kept))
    assert [(s.start, s.end) for s in got[0]] == [(0, 10), (15, 25)]  # the fold would lose the first one


def test_strict_detection_keeps_what_the_fold_loses(spark):
    pats = [SpanPattern("A", "aaaa bb", 0.7), SpanPattern("B", "bb cc", 0.9), SpanPattern("C", "cc dddd", 0.95)]
    df = spark.createDataFrame([(1, "x aaaa bb cc dddd y")], "doc_id long, text string")
    how = {"layer1": pats, "layer3": None}
    assert [e.entity_type for e in D.detect(df, **how).first().entities] == ["C"]
    assert [e.entity_type for e in D.detect(df, strict=True, **how).first().entities] == ["A", "C"]


def test_a_fold_over_one_huge_island_takes_seconds(spark):
    n = 20_000
    df = _rows(spark, [[(0, 10 * n, 0.1)] + [(10 * k, 10 * k + 5, 0.9) for k in range(n)]]).cache()
    df.count()
    start = time.time()
    assert df.select(F.size(S.merge_fold(F.col("sp"))).alias("n")).first().n == n
    assert time.time() - start < 20


def _brute(docs, terms):
    out = set()
    for d, text in docs:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text or "")]
        for t, kind in terms:
            key = [w.lower() for w in re.findall(r"\w+", t)]
            for i in range(len(words) - len(key) + 1):
                if key and [w[2] for w in words[i:i + len(key)]] == key:
                    out.add((d, kind, words[i][0], words[i + len(key) - 1][1]))
    return out


def test_dictionary_behind_bitmaps(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["Ünal", "O'Neill", "x"]
    terms = [(" ".join(rnd.choices(vocab, k=rnd.randint(1, 4))), rnd.choice("AB")) for _ in range(80)] + [("...", "A"), ("", "A")]
    docs = [(i, " ".join(rnd.choice(vocab) + rnd.choice(["", "", ",", " -"]) for _ in range(rnd.randint(0, 60)))) for i in range(120)] + [(200, None)]
    t = spark.createDataFrame([(*x, 0.9) for x in terms], "term string, entity_type string, score double")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = _brute(docs, terms)
    for key in (None, b"k"):
        assert {(r.doc_id, r.entity_type, r.start, r.end) for r in dictionary_spans(d, t, key=key).collect()} == want
    longest = {(r.doc_id, r.entity_type, r.start, r.end) for r in dictionary_spans(d, t, longest=True).collect()}
    assert longest == {x for x in want if not any(o[0] == x[0] and o[2:] != x[2:] and o[2] <= x[2] and o[3] >= x[3] for o in want)}
    plan = dictionary_spans(d, t)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and dictionary_spans(d, t.limit(0)).count() == 0


def test_leaks_across_rows(spark):
    outputs = spark.createDataFrame([(1, "write to <EMAIL_1> or Ann Lee-Smith"), (2, "ann@example.com was left, also 212-555-0100"), (3, "clean"), (4, None)],
                                    "doc_id long, sanitized_text string")
    vault = spark.createDataFrame([("ann@example.com", "EMAIL"), ("212-555-0100", "US_PHONE"), ("212-555-0100", "US_PHONE"), ("Ann Lee-Smith", "PERSON"), ("abc", "X"),
                                   ("nobody@example.com", "EMAIL")], "original string, entity_type string")
    got = {(r.doc_id, r.entity_type) for r in audit.leaks_across_rows(outputs, vault, key=b"secret").collect()}
    assert got == {(1, "PERSON"), (2, "EMAIL"), (2, "US_PHONE")}


def test_context_words_and_flags_are_arguments(spark):
    df = spark.createDataFrame([(1, "badge AB12", "general"), (2, "other ab12", "general")], "doc_id long, text string, context string")
    pats = [SpanPattern("BADGE", r"\bAB\d\d\b", 0.3)]
    how = {"patterns": pats, "contexts": {"general": ("BADGE",)}}
    got = {r.doc_id: [s.score for s in r.rec_spans] for r in D.with_recogniser_spans(
        df, "text", "context", context_words={"BADGE": ("badge",)}, boost=0.2, boosted_least=0.6, **how).collect()}
    assert got == {1: [0.6], 2: [0.3]}
    got = {r.doc_id: [s.score for s in r.rec_spans] for r in D.with_recogniser_spans(df, "text", "context", context_words={}, flags="", **how).collect()}
    assert got == {1: [0.3], 2: []}
