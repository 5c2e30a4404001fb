"""Cross-tokenizer alignment: brute force over whole tables and odd texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from veilspark.llm import token_align
from veilspark.llm.common import read
from veilspark.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  spaces ", "a▁b", "<0x41> <s> </s> <|endoftext|>", "naïve café — 漢字 🙂🙂 é", "tab\tand\r\nlines\n\n",
       "nul\x00byte", "İstanbul ſ K", "   spaces 　", "x" * 3000, "﻿bom", "\U0010ffff", "ﬁ ligature ½", "1234567890 !!!???",
       "the the the", "́ lone mark", "a‍b‌", "<unk>", "<0x0A>\n"]


def _bytes(tok, sp):
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    def a(i):
        s = tok.id_to_token(i)
        return bytes(back[c] for c in s)
    def b(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    return a, b


def brute(rows):
    """``[(id, text)]`` -> rows in the same order, by two nested loops over tokens."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    of_a, of_b = _bytes(tok, sp)
    links, out, held = [], [], defaultdict(int)
    for i, text in rows:
        ids_a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = sp.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, ids_a)) != want or b"".join(map(of_b, ids_b)) != want:
            links.append([])
            out.append([i, 0, 0, 0, 0, ""])
            continue
        spans = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, side = 0, []
            for t in ids:
                side.append((at, at + len(of(t)), t))
                at += len(of(t))
            spans.append(side)
        mine, lo = [], 0
        for s, e, t in spans[0]:
            while spans[1][lo][1] <= s:
                lo += 1
            k = lo
            while k < len(spans[1]) and spans[1][k][0] < e:
                mine.append((t, spans[1][k][2]))
                k += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, start = [], 0
        for e in both:
            groups.append("|".join(",".join(str(t) for s, x, t in side if start <= s and x <= e) for side in spans) if len(both) < 400 else None)
            start = e
        if len(both) >= 400:  # the same in one walk
            groups, ia, ib = [], 0, 0
            for e in both:
                ga, gb = [], []
                while ia < len(spans[0]) and spans[0][ia][1] <= e:
                    ga.append(str(spans[0][ia][2]))
                    ia += 1
                while ib < len(spans[1]) and spans[1][ib][1] <= e:
                    gb.append(str(spans[1][ib][2]))
                    ib += 1
                groups.append(",".join(ga) + "|" + ",".join(gb))
        links.append(mine)
        out.append([i, len(ids_a), len(ids_b), len(both), len(mine), ";".join(groups)])
    for mine in links:
        for p in set(mine):
            held[p] += 1
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    for row, mine in zip(out, links, strict=True):
        row[5:5] = [sum(held[p] == most[p[0]] for p in mine), sum(held[p] for p in mine)]
    return [tuple(r) for r in out]


def _got(df, **how):
    return Counter(tuple(r) for r in token_align.align(df, A, B, **how).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())


def test_units_give_the_libraries_ids():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        enc = token_align.Encoders(f.read(), g.read())
    assert enc.a_cut and enc.b_cut
    rnd = random.Random(9)
    alphabet = [*" \n\t\r\x0b\x0c'stmdrevl''  aàñ1²½!?.,́漢字　😀ſİ\xa0\x85\x1c\x1f\u200b#$ ▁\x00ǅʰªº×÷ΩÐ", "<|endoftext|>", "<s>", "<0x41>", "'ve", " the", "ing", "'ll"]
    texts = ["".join(rnd.choices(alphabet[:rnd.randint(5, len(alphabet))], k=rnd.randint(1, 40))) for _ in range(6000)]
    a, b = enc.encode(texts)
    assert a.to_pylist() == [e.ids for e in enc.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert b.to_pylist() == enc.b.encode(texts)


def test_odd_texts(spark):
    rnd = random.Random(3)
    pieces = [*"abc éß漢🙂\n\t▁", " the", "ing", " 12", "<0x0A>", "…", "́", "  "]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "".join(rnd.choices(pieces, k=rnd.randint(1, 60)))) for i in range(300)]
    rows += [(900, None), (901, "the the the"), (901, "the the the"), (None, "no id"), (902, "long text of words " * 20000)]
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "doc_id long, text string, n int, a int, chunk string")
    got, want = _got(df), Counter(brute(rows))
    assert got == want
    assert sum(n for r, n in want.items() if r[1]) > 80 and any(r[3] < min(r[1:3]) for r in want if r[1])
    assert token_align.align(df.limit(0), A, B).count() == 0
    nothing = df.where("text is null")
    assert _got(nothing) == Counter([(900, 0, 0, 0, 0, 0, 0, "")])


def test_small_chunks_give_the_same(spark, monkeypatch):
    docs = read(spark, SF_SMALL, "documents").select("doc_id", "text")
    want = _got(docs)
    small = token_align.chunks
    monkeypatch.setattr(token_align, "chunks", lambda *a: small(*a, chunk_bytes=5000))
    assert _got(docs.repartition(3)) == want


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in read(spark, SF_SMALL, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_align"](spark, SF_SMALL)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    want = Counter((*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(rows))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want
