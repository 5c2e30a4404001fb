"""Language ID, quality and HTML extraction: held-out accuracy, edges, brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from veilspark.llm import html_extract, langid, quality
from veilspark.llm.common import held_out, read
from veilspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score string, _langid int"
WORDS = {"en": "the thing and nothing whether there", "de": "der und nicht einung keitsch über", "fr": "le une était eaux quelle"}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i * 3 + j, f"{t} {t} {i}", lang, "s", 1) for i in range(12) for j, (lang, t) in enumerate(WORDS.items())]
    rows += [(100, None, "en", None, 1), (101, "", None, "x", None), (102, "123 !? 漢", "de", "x", 2), (102, "12 -- 3", None, "x", 2),
             (None, "the thing and nothing", None, "y", 3), (104, "the thing " * 200_000, "en", "z", 3), (105, "the thing", None, None, 1),
             (105, "the thing", None, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_edges(edges):
    profiles = langid.learn_profiles(edges.where("lang is not null and doc_id < 100"))
    assert sorted(profiles) == ["de", "en", "fr"]
    out = langid.identify(edges, profiles, score_out="lang_score")
    assert out.columns == [*edges.columns, "lang_pred", "lang_score"]
    got = [(r.doc_id, r.text, r.lang_pred, r.lang_score) for r in out.collect()]
    assert len(got) == edges.count()
    by = {(i, t and t[:9]): (p, s) for i, t, p, s in got}
    assert by[100, None] == by[101, ""] == by[102, "12 -- 3"] == ("und", 0.0)
    assert by[None, "the thing"][0] == by[104, "the thing"][0] == by[105, "the thing"][0] == "en"
    assert all(0 <= s <= 1 for *_, s in got)
    assert langid.identify(edges.limit(0), profiles).count() == 0
    assert langid.learn_profiles(edges.limit(0)) == {}
    assert {r.lang_pred for r in langid.identify(edges, {}).collect()} == {"und"}


def test_text_vector_is_the_sum_over_trigrams(monkeypatch):
    def brute(text):
        s = "".join(c.lower() if c.isalpha() else " " for c in text)
        s = " " + " ".join(s.split()) + " "
        code = lambda c: 0 if c == " " else ord(c)
        return sum((np.roll(langid._vector(code(a)), 2) * np.roll(langid._vector(code(b)), 1) * langid._vector(code(c)).astype(int)
                    for a, b, c in zip(s, s[1:], s[2:])), np.zeros(langid.DIM, int))

    texts = ["Hello, wörld -- of  THINGS", "x", "", "a1b2c3 d", "ab " * 50]
    assert np.array_equal(langid.text_vectors(texts)[0], brute(texts[0]))
    want = langid.text_vectors(texts)
    monkeypatch.setattr(langid, "_PIECE", 7)  # many pieces a text
    assert np.array_equal(langid.text_vectors(texts), want)


def test_language_held_out_accuracy(spark):
    got = QUERIES["op7_language_id"](spark, SF_CHECK)
    truth = read(spark, SF_CHECK, "documents").select("doc_id", "lang")
    assert got.count() == truth.count()
    assert got.where("score < 0 or score > 1").isEmpty()
    acc = got.join(truth, "doc_id").where("held_out and lang is not null").agg(F.avg(F.expr("cast(lang = lang_pred as int)"))).first()[0]
    assert acc > 0.97


def test_held_out_is_the_crc(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_quality_edges(spark):
    good = [(i, f"Plain words here number {i} and more of them follow in order today.") for i in range(20)]
    bad = [(100 + i, "BUY!! NOW!! CHEAP!! " * (3 + i)) for i in range(20)]
    docs = spark.createDataFrame([*good, *bad, (200, None), (201, ""), (None, "Plain words here and more of them follow in order."),
                                  (202, "BUY!! " * 100_000), (203, good[0][1]), (203, good[0][1])], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("old")).withColumn("_label", F.lit(1))
    labels = spark.createDataFrame([*[(i, 1) for i, _ in good], *[(i, 0) for i, _ in bad], (None, 1), (0, 1), (999, 0), (5, None)],
                                   "doc_id long, quality int")
    model = quality.learn(docs.drop("_label"), labels)
    out = quality.score_quality(docs, model, out="q")
    got = [(r.doc_id, r.text, r.q) for r in out.collect()]
    assert out.columns == [*docs.columns, "q"] and len(got) == docs.count()
    for i, t, q in got:
        assert q == 0 if not t else q > 0.9 if t.startswith("Plain") else q < 0.1
    assert quality.learn(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.0}
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_quality_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 4, (60, quality.SHAPES + quality.PAIRS + quality.NOVELTY)).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    m = quality.Neighbours(counts, labels, dim=8)
    q = rng.integers(0, 4, (5, counts.shape[1])).astype(np.float32)
    got = m.score(q)
    v = quality._unit(quality._weigh(q, m.idf) @ m.basis)
    for i in range(5):
        near = sorted(((float(v[i] @ p), int(y)) for p, y in zip(m.points, labels)), reverse=True)[:quality.NEIGHBOURS]
        w = [(max(c, 0) ** quality.POWER, y) for c, y in near]
        assert got[i] == pytest.approx(sum(a * y for a, y in w) / sum(a for a, _ in w), abs=1e-5)


def test_quality_held_out_accuracy(spark):
    got = QUERIES["op2_quality"](spark, SF_CHECK)
    labels = read(spark, SF_CHECK, "labels").select("doc_id", "quality")
    assert got.count() == read(spark, SF_CHECK, "documents").count()
    acc = got.join(labels, "doc_id").where("held_out").agg(F.avg(F.expr("cast(quality = predicted as int)"))).first()[0]
    assert acc > 0.95


LAYOUT = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>if (a<b) "</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=x>One</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
{open}<h1>Head &lt;line&gt;</h1><p>First  para with <b>bold</b>ness<br>here.</p><div class="ad-slot">Buy it</div><p>Second&nbsp;para &eacute;.
<ul><li>item one</li><li>item two <a href=y>link</a></ul>{close}
<section class="comments"><p>Nice post, I like this one a lot.</p></section><form><p>Sign up</p></form>
<aside>More things</aside><footer>&copy; us</footer></body></html>"""
MAIN = "Head <line> First para with boldness here. Second para é. item one item two link"


def test_html_layouts():
    learnt = html_extract.weights(*html_extract.page_counts(LAYOUT.format(open="<article>", close="</article>")))
    for a, b in (("<article>", "</article>"), ('<div class="post-content">', "</div>"), ("<main>", "</main>"), ("<div>", "</div>")):
        page = LAYOUT.format(open=a, close=b)
        assert html_extract.main_text(page, learnt) == MAIN
        assert html_extract.main_text(page, html_extract.DEFAULT) == MAIN
    for page, text in ((None, ""), ("", ""), ("<p", ""), ("<script>x", ""), ("a &am", "a &am"), ("<p>a<!-- b", "a"), ("<article></article>", "")):
        assert html_extract.main_text(page, learnt) == text


def test_html_names_of_wrappers_do_not_empty_a_page():
    learnt = html_extract.weights(*html_extract.page_counts(LAYOUT.format(open="<article>", close="</article>")))
    story = "".join(f"<p>Paragraph {i} of the story goes on for some more words.</p>" for i in range(9))
    want = " ".join(f"Paragraph {i} of the story goes on for some more words." for i in range(9))
    around = (('<body class="has-sidebar">', "</body>"), ('<body><div class="layout sidebar-right">', "</div></body>"),
              ('<body><form id="form1">', "</form></body>"), ('<body><form id="form1"><fieldset>', "</fieldset></form></body>"))
    menu = '<nav><a href="x">Menu</a></nav><div class="ad">Buy it</div>'
    for a, z in around:
        for b, y in (("", ""), ("<article>", "</article>"), ("<main>", "</main>"), ('<main class="has-sidebar">', "</main>"),
                     ('<main><div class="layout sidebar-left">', "</div></main>")):
            page = f'<html>{a}{menu}{b}{story}{y}<aside>More things</aside></html>{z}'
            for w in (learnt, html_extract.DEFAULT):
                assert html_extract.main_text(page, w) == want, (a, b)
    # comments stay out, also as articles
    notes = '<div id="comments"><ol class="comment-list"><li><article class="comment-body"><p>Nice post.</p></article></li></ol></div>'
    assert html_extract.main_text(f"<body><article>{story}</article>{notes}</body>", learnt) == want


def _story(extra="", n=6):
    text = [f"Paragraph {i} of the story goes on for some more words." for i in range(n)]
    return "".join(f"<p>{x}</p>" for x in text[:3]) + extra + "".join(f"<p>{x}</p>" for x in text[3:]), text


def test_html_pages_as_written():
    learnt = html_extract.weights(*html_extract.page_counts(LAYOUT.format(open="<article>", close="</article>")))
    inside = {  # what stands in the article and belongs to it
        '<h2 id="related-work">Related work</h2>': "Related work", '<h2 class="related">Related work</h2>': "Related work",
        '<p class="share-price">The price rose.</p>': "The price rose.", '<p data-id="ad">A plain line.</p>': "A plain line.",
        '<fieldset><p>A framed line.</p></fieldset>': "A framed line.", "<p title=it's>It is said.</p>": "It is said.",
        '<p title="a>b" x=\'c>d\'>Quoted values.</p>': "Quoted values.", '<p data-x=">" class=lead>More.</p>': "More.",
        '<section id="popular-music">' + "".join(f"<p>Line {i} on music and those who play it.</p>" for i in range(5)) + "</section>":
            " ".join(f"Line {i} on music and those who play it." for i in range(5)),
        '<div class="ad-slot">Buy it</div>': None, '<aside>Aside</aside>': None, '<div class="social-share">Share</div>': None,
        '<div class="related-articles"><a href=x>Read on</a></div>': None, '<form><p>Sign up</p></form>': None}
    for w in (learnt, html_extract.DEFAULT):
        for extra, said in inside.items():
            body, text = _story(extra)
            want = " ".join(text[:3] + ([said] if said else []) + text[3:])
            for page in (f"<html><head><title>x</title></head><body><nav><a href=x>Menu</a></nav><article>{body}</article><footer>foot</footer></body></html>",
                         f"<title>x</title><body><article>{body}</article><footer>foot</footer>"):
                assert html_extract.main_text(page, w) == want, (extra, page)
        body, text = _story()
        want = " ".join(text)
        for head in ("<head><title>x</title><body>", "<html><head><meta charset=utf-8><link href=a>", "<head><title>x</title>", "<head>\n<script>a<b</script>\n"):
            assert html_extract.main_text(f"{head}<article>{body}</article>", w) == want, head
        assert html_extract.main_text("<head><title>x</title>Bare text of a page without tags", w) == "Bare text of a page without tags"


def test_html_deep_and_broken_pages_take_their_length():
    import time
    start = time.process_time()
    text = [f"Line {i} of it." for i in range(4000)]
    assert html_extract.main_text("<body><article>" + "".join(f"<div><p>{x}" for x in text), html_extract.DEFAULT) == " ".join(text)
    assert html_extract.main_text("<body><article>" + "".join(f"<div class=a{i}><b><i></u></em><p>{x}" for i, x in enumerate(text[:1500])), html_extract.DEFAULT)
    assert "end" in html_extract.main_text("<p a=" + '"\'=' * 30_000 + "><p>the end of it", html_extract.DEFAULT)
    assert time.process_time() - start < 8


def test_html_all_pages_against_their_blocks():
    """Every page of the table: the article's text without markup, word for word."""
    import html as entities
    import re

    import duckdb
    pages = [r[0] for r in duckdb.connect().execute(f"SELECT html FROM '{SF_CHECK}/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    counts = [html_extract.page_counts(p) for p in pages]
    learnt = html_extract.weights(sum((c[0] for c in counts if c), html_extract.Counter()), sum((c[1] for c in counts if c), html_extract.Counter()))
    good = said = wanted = 0
    for p in pages:
        m = re.search(r"<article>(.*?)</article>", p, re.S)
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|aside|nav|form)\b.*?</\1>|<div class=\"ad\">.*?</div>", " ", m[1] if m else "")
        want = entities.unescape(re.sub(r"<(?!/?(b|i|em|strong|a|span)\b)[^>]+>", " ", plain))
        want = re.sub(r"<[^>]+>", "", want).split()
        got = html_extract.main_text(p, learnt).split()
        good += sum((html_extract.Counter(want) & html_extract.Counter(got)).values())
        said, wanted = said + len(got), wanted + len(want)
    assert wanted and good / said > 0.99 and good / wanted > 0.99, (good / said, good / wanted)


def test_best_region_is_the_maximum_sum():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.integers(-4, 5, rng.integers(0, 12)).tolist()
        a, z = html_extract.best_region(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:z]) == best and (best > 0 or a == z)


def test_html_query(spark):
    pages = read(spark, SF_SMALL, "pages")
    got = {r.page_id: r for r in QUERIES["op9_html_extract"](spark, SF_SMALL).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inside = r.html.partition("<article>")[2].partition("</article>")[0]
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
        assert "<p>" not in got[r.page_id].text and bool(got[r.page_id].text) == bool(inside)
    extra = pages.limit(3).withColumn("text", F.lit(1)).withColumn("_text", F.lit(2)).unionByName(pages.limit(0), allowMissingColumns=True)
    assert html_extract.extract(extra, html_extract.learn_weights(extra), out="main").columns == [*extra.columns, "main"]
    assert html_extract.learn_weights(pages.limit(0)) == html_extract.DEFAULT
    assert html_extract.extract(pages.limit(0), {}).count() == 0
