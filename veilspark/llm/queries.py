"""Registered queries over the operators, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, langid, lexical_search, line_dedup, packing, projection_passes, quality, rules, sharding, simhash, token_align, token_counts
from .sql_rules import OP6
from .common import held_out, read


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs.where(~held_out()))
    return langid.identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, max_bits=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Small shards, so that even the smallest table needs several.
SHARD_BYTES = 1 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SHARD_BYTES)


_OP1 = f"""
WITH r AS (SELECT row_number() OVER () AS row, doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
                  coalesce(strlen(text), 0) AS n_bytes FROM documents),
lv AS (SELECT row, h, n_bytes, d, h >> (60 - d)::INT AS p FROM r, range(61) t(d)),
sz AS (SELECT row, d, sum(n_bytes) OVER w AS size, count(*) OVER w AS n FROM lv WINDOW w AS (PARTITION BY d, p)),
leaf AS (SELECT row, min(d) AS d FROM sz WHERE size <= {SHARD_BYTES} OR n = 1 GROUP BY row)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, d::INT AS local_depth, n_bytes > {SHARD_BYTES} AS oversized,
       CASE WHEN d = 0 THEN '-' ELSE right(lpad(bin(h >> (60 - d)::INT), 60, '0'), d::INT) END AS shard
FROM r JOIN leaf USING (row)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    scored = quality.score_quality(docs, quality.learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


_OP3 = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, lines, i, len(regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+')) AS w
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
fwd AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
        AND b.upto - a.upto + a.w >= {line_dedup.MIN_WORDS} GROUP BY ALL),
bwd AS (SELECT b.doc_id, max(a.i) AS a, b.i AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i
        AND b.upto - a.upto + a.w >= {line_dedup.MIN_WORDS} GROUP BY b.doc_id, b.i),
win AS (SELECT * FROM fwd UNION SELECT doc_id, a, b FROM bwd),
txt AS (SELECT win.*, array_to_string(lines[a:b], chr(10)) AS t FROM win JOIN d USING (doc_id)),
later AS (SELECT doc_id, a, b FROM txt QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
             coalesce(string_agg(lines[l.i], chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, k.text
FROM documents LEFT JOIN k USING (doc_id)
"""


def pack_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.learn_weights(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks")).select("doc_id", "item_id", "windows", "share")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.rank(docs, read(spark, sf_dir, "benchmark"), top=10)


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
st AS (SELECT count(*)::BIGINT AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d)
       WHERE t IN (SELECT t FROM q) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY t),
im AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))) AS x FROM tf JOIN wt USING (t), st),
sc AS (SELECT item_id, r, doc_id, sum(x)::BIGINT AS score FROM q JOIN im USING (t) GROUP BY ALL HAVING sum(x) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM sc QUALIFY rank <= 10
"""


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups="sha256")
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.93)


#: All pairs of a label; the passes find these too.
_OP13 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT r, vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
      WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
         WHERE CASE WHEN len(a.e) = len(b.e) THEN list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93 END),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY a),
deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v LEFT JOIN deg ON v.r = deg.a JOIN comp ON v.r = comp.a
"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_html_extract": op9_html_extract,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_align": op12_token_align,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLES: dict[str, str] = {
    "op1_sharding": _OP1,
    "op3_line_dedup": _OP3,
    "op6_quality_rules": OP6,
    "op11_lexical_search": _OP11,
    "op13_embedding_dedup": _OP13,
}
