"""Ranked lexical search: brute force over odd documents, ties, hot terms, blocks of items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import SF_CHECK, SF_SMALL
from veilspark.llm import lexical_search as ls
from veilspark.llm.common import read
from veilspark.llm.queries import QUERIES

_TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def _terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = Counter()
    for item, terms in asked.items():
        found = []
        for doc, c, size in counts:
            m = 10 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, doc is None, doc if doc is not None else 0, doc))
        for k, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top]):
            out[item, k + 1, doc, -s] += 1
    return out


def test_terms():
    odd = "".join(map(chr, range(0x250))) + "漢字 İ😀x_y z\x85w"
    assert [t.decode() for t in ls.terms_of(odd)] == _terms(odd)
    assert ls.terms_of(None) == ls.terms_of("!! _") == []


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(120)] + ["The", "tHe", "é", "漢字", "x1"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weight, k=rnd.randint(1, 80)))) for i in range(900)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(i, "the w3, w3; w100!") for i in (7, 7, 7)]  # ties and repeated rows
    docs += [(2000, None), (2001, ""), (2002, "?! _"), (None, docs[5][1]), (None, "w90 w91"), (2003, "w1 " * 50_000 + "w99")]
    docs += [(3000 + i, "the the w0") for i in range(500)]  # a third of the rows hold one term
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "unknown word"), (103, "w5"), (103, "w6 w5"), (103, "w6 w5"), (None, "w7 w8"), (104, docs[5][1]), (105, "the")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"top": 3}, {"block_terms": 300}])
def test_equals_brute_force(spark, tables, how, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(ls, "BUCKET", 64)
    a = spark.createDataFrame([(*d, 0, 0.5, "x") for d in docs], "doc_id long, text string, n int, norm double, term string").repartition(5)
    b = spark.createDataFrame([(*i, 0, 1) for i in items], "item_id long, text string, rank int, doc_id int")
    got = ls.rank(a, b, **how)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, items, how.get("top", 10))


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    items = spark.createDataFrame(tables[1], "item_id long, text string")
    assert ls.rank(docs.limit(0), items).count() == 0
    assert ls.rank(docs, items.limit(0)).count() == 0
    assert ls.rank(docs.where("text is null"), items).count() == 0


def test_bounds_prune_and_lose_nothing():
    """Fewer rows are rescored than hold a term, and none that counts is lost."""
    rnd = np.random.RandomState(1)
    terms = [np.unique(rnd.zipf(1.3, 20) % 400).astype(np.int32) for _ in range(3000)]
    values = [(1000 * (1 + t) * rnd.uniform(0.5, 1, len(t))).astype(np.int64) for t in terms]
    norms = np.array([math.sqrt(float(v.astype(float) @ v)) for v in values])
    order = np.argsort(-norms)
    bucket = ls.Bucket([terms[i] for i in order], [values[i] for i in order], norms[order])
    touched = holding = 0
    for _ in range(50):
        item = np.unique(rnd.randint(0, 400, 12))
        score = np.array([values[i][np.isin(terms[i], item)].sum() for i in order])
        least = int(np.sort(score)[-10])
        rows, got = bucket.survivors(item, least)
        assert set(np.flatnonzero(score >= least)) <= set(rows.tolist())
        assert (got == score[rows]).all()
        touched += len(rows)
        holding += (score > 0).sum()
    assert touched < holding / 3


def test_query(spark):
    for sf in (SF_SMALL, SF_CHECK):
        docs, items = ([tuple(r) for r in read(spark, sf, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
        assert Counter(tuple(r) for r in QUERIES["op11_lexical_search"](spark, sf).collect()) == brute(docs, items)
