"""The pipeline against a plain statement of its stages, on small tables."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF_SMALL
from test_dedup import _brute_lines, _print, _roots
from veilspark.llm import decontam, langid, line_dedup
from veilspark.llm.common import Scratch, held_out, read


def _stages(spark, docs, sf):
    scratch, out = Scratch(spark, "test"), []
    for _, f in corpus_pipeline.STAGES:
        docs = scratch.cut(f(spark, docs, sf))
        out.append(docs)
    return out


def _brute(spark, docs, sf):
    """Surviving (doc_id, text) after each of the first four stages."""
    profiles = langid.learn_profiles(docs.where(~held_out()))
    protos = np.stack([profiles[k] for k in sorted(profiles)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    v = langid.text_vectors([t or "" for _, t in rows])
    cos = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ protos.T
    texts = [r.text for r in docs.where(~held_out()).where("lang is not null").collect()]
    used = set("".join(t or "" for t in texts).lower())

    def short(t):
        letters = [c for c in t.lower() if c.isalpha()]
        return len(letters) < corpus_pipeline.SHORT_LETTERS and 2 * sum(c in used for c in letters) >= len(letters)

    rows = [r for r, c, x in zip(rows, cos.max(axis=1), v) if x.any() and (c >= corpus_pipeline.MIN_LANGUAGE_SCORE or short(r[1]))]
    out = [sorted(rows)]
    cleaned = _brute_lines(rows, line_dedup.MIN_WORDS)
    rows = [(i, cleaned[i, t]) for i, t in rows if cleaned[i, t]]
    out.append(sorted(rows))
    fp = {i: _print(t) for i, t in rows}
    ids = sorted(fp)
    roots = _roots([(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 2], ids)
    rows = [r for r in rows if roots[r[0]] == r[0]]
    out.append(sorted(rows))
    items = decontam.Items([(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()], decontam.SIMILARITY)
    out.append(sorted(r for r in rows if not items.search(*decontam.Reader().template(r[1]))))
    return out


def test_pipeline_equals_its_stages_stated_plainly(spark):
    docs = read(spark, SF_SMALL, "documents").where("n_chars < 3000")  # the brute force is cubic in lines
    got = _stages(spark, docs, SF_SMALL)
    want = _brute(spark, docs, SF_SMALL)
    for frame, rows in zip(got[:-1], want):
        assert frame.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in frame.collect()) == rows
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in want[-1]}
    packed = got[-1].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in packed} == {r.doc_id: r.m for r in packed} == sizes


def test_pipeline_edges(spark):
    docs = read(spark, SF_SMALL, "documents").limit(20)
    some = docs.select("text").first().text
    odd = spark.createDataFrame([(None, some, None, None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0),
                                 (9003, some, "en", "s", None), (9003, some, "en", "s", None), (9004, "12 !!", "en", "s", 5)], docs.schema)
    extra = docs.unionByName(odd).select("*", *[F.lit(1).alias(c) for c in ("n_lines", "n_removed", "_leaks", "_lang_pred", "fp", "th", "_text_hash")])
    got = _stages(spark, extra, SF_SMALL)
    for frame in got[:-1]:
        assert frame.columns == extra.columns
    left = [r.doc_id for r in got[0].collect()]
    assert 9001 not in left and 9002 not in left and 9004 not in left and left.count(9003) == 2 and None in left
    assert sum(r.text == some for r in got[2].collect()) == 1
    assert [f.count() for f in _stages(spark, docs.limit(0), SF_SMALL)] == [0] * 5


def test_language_stage_rejects_unseen_scripts_and_keeps_short_texts(spark):
    docs = read(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    rng = np.random.default_rng(3)
    alien = [" ".join("".join(chr(a + int(c)) for c in rng.integers(0, w, 6)) for _ in range(n))
             for a, w in ((0x430, 32), (0x3B1, 24), (0x5D0, 27), (0x4E00, 3000)) for n in (1, 2, 5, 20, 200) for _ in range(10)]
    kept = ["Avec.", "A.", "All rights reserved.", "Edrere."]
    rows = [(10_000 + i, t, None) for i, t in enumerate(alien)] + [(20_000 + i, t, None) for i, t in enumerate(kept)]
    out = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), SF_SMALL)
    ids = {r.doc_id for r in out.collect()}
    assert not [i for i in ids if 10_000 <= i < 20_000]
    assert {i for i in ids if i >= 20_000} == {20_000 + i for i in range(len(kept))}
