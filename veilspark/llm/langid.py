"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1/-1 (bits of a hash of its code point).
A trigram's vector is the product of its letters' vectors, the first permuted
twice, the second once (cyclic shifts), the third not at all.  A text's vector
is the sum of its trigrams' vectors; a language's prototype is the sum of the
unit vectors of its learning texts.  The prediction is the prototype with the
largest cosine.

Sums run over the whole text: letters are lower-cased, each run of anything
else is one boundary symbol.  A batch needs memory for ``_PIECE`` symbols;
longer texts go through in pieces whose trigram sums add up exactly.

Defined results: null, empty and letterless texts get ``und`` and score 0.
Ties go to the language first in code-point order.  Repeated rows are
predicted each on their own; an empty table gives an empty result.  With no
learning rows every text is ``und``.  Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

DIM = 1024
UNKNOWN = "und"
_PIECE = 1 << 20  # symbols worked on together
_TEXTS = 256  # texts worked on together
_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for all that are no letters."""
    global _letters
    if _letters is None:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                t[c] = ord(s.lower()[0])
        _letters = t
    return _letters


def _vector(code: int) -> np.ndarray:
    v = _vectors.get(code)
    if v is None:
        if len(_vectors) > 8192:
            _vectors.clear()
        bits = np.unpackbits(np.frombuffer(hashlib.shake_256(code.to_bytes(4, "little")).digest(DIM // 8), np.uint8))
        v = _vectors[code] = (bits.astype(np.int8) * 2 - 1)
    return v


def _pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, symbols): letters and single boundaries (0), one boundary at
    either end; pieces of one text overlap by two symbols."""
    table = _letter_table()
    for i, text in enumerate(texts):
        tail = np.zeros(1, np.uint32)
        for a in range(0, len(text), _PIECE):
            cps = np.frombuffer(text[a:a + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.concatenate([tail, table[cps], np.zeros(int(a + _PIECE >= len(text)), np.uint32)])
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
            yield i, s
            tail = s[-2:]


def text_vectors(texts: list[str]) -> np.ndarray:
    """One row per text: the sum of its trigrams' vectors (zero if it has no letter)."""
    out = np.zeros((len(texts), DIM), np.float32)
    group: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        sizes = [len(s) for _, s in group]
        s = np.concatenate([s for _, s in group]).astype(np.int64)
        row = np.repeat(np.arange(len(group)), sizes)
        ok = row[:-2] == row[2:]
        key = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[ok]
        if len(key):
            grams, pos = np.unique(key, return_inverse=True)
            mask = (1 << 21) - 1
            parts = []
            for shift, roll in ((42, 2), (21, 1), (0, 0)):
                codes, at = np.unique((grams >> shift) & mask, return_inverse=True)
                parts.append((np.stack([np.roll(_vector(int(c)), roll) for c in codes]), at))
            width = 4096
            where = row[:-2][ok]
            counts = np.bincount(where * len(grams) + pos, minlength=len(group) * len(grams))
            counts = counts.reshape(len(group), len(grams)).astype(np.float32)
            total = np.zeros((len(group), DIM), np.float32)
            for a in range(0, len(grams), width):
                (x, i), (y, j), (z, k) = [(v, at[a:a + width]) for v, at in parts]
                total += counts[:, a:a + width] @ (x[i] * y[j] * z[k]).astype(np.float32)
            np.add.at(out, [i for i, _ in group], total)
        group.clear()

    for i, s in _pieces(texts):
        if len(s) < 3:  # boundaries only
            continue
        if group and (size + len(s) > _PIECE or len(group) >= _TEXTS):
            flush()
            size = 0
        group.append((i, s))
        size += len(s)
    flush()
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _learning_rows(df: DataFrame, text_col: str, lang_col: str, key_col: str, rows_per_language: int, max_languages: int) -> DataFrame | None:
    """``(lang, text)`` of about ``rows_per_language`` rows a language, by a hash of the key."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(key_col).cast("string").alias("k"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} language labels")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, rows_per_language / n)])
    picked = rows.where((F.xxhash64("k") % (1 << 20) + (1 << 20)) % (1 << 20) < F.element_at(share, F.col("lang")) * (1 << 20))
    return picked.select("lang", "text")


def learn_letters(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
                  rows_per_language: int = 2000, max_languages: int = 1000, least: float = 0.01) -> str:
    """The letters, lower-cased and in order, that at least the share ``least``
    of some language's learning rows hold ('' without such rows)."""
    picked = _learning_rows(df, text_col, lang_col, key_col, rows_per_language, max_languages)
    if picked is None:
        return ""
    letters = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}"), F.lit(0))))
    n = picked.groupBy("lang").agg(F.count("*").alias("rows"))
    held = picked.select("lang", letters.alias("letter")).groupBy("lang", "letter").agg(F.count("*").alias("n"))
    # at most 1 / least times a text's distinct letters, per language
    found = held.join(n, "lang").where(F.col("n") >= least * F.col("rows")).select("letter").distinct().collect()
    return "".join(sorted(r["letter"] for r in found))


def known_letters(text: Column, letters: str) -> tuple[Column, Column]:
    """Letters of a text, and how many of them are among ``letters``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    own = F.length(F.regexp_replace(low, r"[^\p{L}]+", ""))
    return own, F.length(F.regexp_replace(low, f"[^{letters}]+", "")) if letters else F.lit(0)


def learn_profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
                   rows_per_language: int = 2000, max_languages: int = 1000) -> dict[str, np.ndarray]:
    """Language -> prototype (unit vector), from about ``rows_per_language``
    rows of each language, chosen by a hash of ``key_col`` (all of them where
    there are no more).  More than ``max_languages`` labels is an error: the
    prototypes go to every task."""
    picked = _learning_rows(df, text_col, lang_col, key_col, rows_per_language, max_languages)
    if picked is None:
        return {}

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            v = _unit(text_vectors(pdf["text"].tolist()))
            for lang, at in pdf.groupby("lang").indices.items():
                total[lang] = total.get(lang, 0) + v[at].astype(np.float64).sum(axis=0)
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [x.tolist() for x in total.values()]})

    small_batches(df.sparkSession)
    # Bounded rows by now (rows_per_language x languages): a few even tasks.
    parts = picked.repartition(8).mapInPandas(sums, "lang string, v array<double>").collect()
    total: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r["lang"], r["v"])):
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["v"])
    return {k: (total[k] / max(np.linalg.norm(total[k]), 1e-12)).astype(np.float32) for k in sorted(total)}


def identify(df: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text",
             lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``df`` plus the predicted language and its cosine (0 to 1)."""
    spark = df.sparkSession
    small_batches(spark)
    names = sorted(profiles)
    known = spark.sparkContext.broadcast((names, np.stack([profiles[k] for k in names]) if names else None))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, protos = known.value
        for s in batches:
            v = text_vectors([x or "" for x in s])
            lang, score = np.full(len(s), UNKNOWN, object), np.zeros(len(s))
            if langs:
                cos = _unit(v) @ protos.T
                best = cos.argmax(axis=1)
                some = v.any(axis=1)
                lang[some] = np.array(langs, object)[best[some]]
                score[some] = np.clip(cos[np.arange(len(s)), best][some], 0, 1)
            yield pd.DataFrame({"lang": lang, "score": score})

    tmp, = fresh(df, "_langid")
    keep = [c for c in df.columns if c not in (lang_out, score_out)]
    return df.withColumn(tmp, predict(F.col(text_col))).select(
        *keep, F.col(f"{tmp}.lang").alias(lang_out), F.col(f"{tmp}.score").alias(score_out))
