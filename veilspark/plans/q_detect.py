"""Detection queries: per-pattern spans, recognisers, merge, allow-list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import SpanPattern
from ..functions import spans as S
from ..operators import detect as D
from ..operators.external import attach_external_spans
from ..sources import notes as N
from ..sources import tables
from . import sqlgen
from ..functions.rows import explode_rows
from .registry import register

NOTES = f"({N.notes_sql()})"


def _long(df: DataFrame, id_col: str, spans_col: str, id_alias: str = "note_id") -> DataFrame:
    """Array of spans -> one row per span with flat scalar columns."""
    e = explode_rows(df, [F.col(id_col).alias(id_alias)], spans_col, "sp")
    return e.select(
        F.col(id_alias).cast("bigint").alias(id_alias),
        F.col("sp.entity_type").alias("entity_type"),
        F.col("sp.start").cast("bigint").alias("pos_start"),
        F.col("sp.end").cast("bigint").alias("pos_end"),
        F.round(F.col("sp.score"), 4).alias("score"),
        F.col("sp.text").alias("value"),
    )


def _long_sql(spans_sql: str, id_alias: str = "note_id") -> str:
    return (f"SELECT CAST(id AS BIGINT) AS {id_alias}, et AS entity_type, CAST(s AS BIGINT) AS pos_start, "
            f"CAST(e AS BIGINT) AS pos_end, round(sc, 4) AS score, x AS value FROM ({spans_sql})")


@register("notes_view", f"SELECT note_id, context, text FROM {NOTES}")
def notes_view(spark, sf):
    """The derived advisor-notes table (input of the detection checks)."""
    return N.notes(spark, sf)


def _pattern_query(p: SpanPattern, ord_: int):
    name = f"detect_{p.entity_type.lower()}"
    sql = _long_sql(sqlgen.pattern_spans_sql(NOTES, "note_id", "text", p, 0, ord_))

    def q(spark, sf):
        n = S.with_pattern_spans(N.notes(spark, sf), "text", [p], "sp", source=0, ord_offset=ord_, raw=True)
        return _long(n, "note_id", "sp")

    q.__doc__ = f"R{ord_ + 1}: every {p.entity_type} match (value span, offsets, score) over the notes."
    register(name, sql)(q)


for _i, _p in enumerate(catalog.LAYER1_PATTERNS):
    _pattern_query(_p, _i)


def _recogniser_query(name: str, entity: str):
    pats = [p for p in catalog.LAYER3_PATTERNS if p.entity_type == entity]
    offs = [i for i, p in enumerate(catalog.LAYER3_PATTERNS) if p.entity_type == entity]
    union = "\nUNION ALL\n".join(sqlgen.pattern_spans_sql(NOTES, "note_id", "text", p, 1, o, "ism")
                                 for p, o in zip(pats, offs))
    sql = _long_sql(union)

    def q(spark, sf):
        rp = [D._recogniser_pattern(p) for p in pats]
        n = S.with_pattern_spans(N.notes(spark, sf), "text", rp, "sp", source=1, ord_offset=offs[0], raw=True)
        return _long(n, "note_id", "sp")

    q.__doc__ = f"Layer 3 {entity} recogniser matches (recogniser flags) over the notes."
    register(name, sql)(q)


_recogniser_query("detect_account_ref", "ACCOUNT_REF")
_recogniser_query("detect_policy", "POLICY_NUMBER")


_CUSIP_SQL = (f"SELECT note_id, entity_type, pos_start, pos_end, score, value FROM ("
              f"{_long_sql('SELECT * FROM ' + sqlgen.recogniser_spans_sql(NOTES, 'note_id', 'text', 'context'))})"
              f" WHERE entity_type = 'CUSIP'")


@register("detect_cusip", _CUSIP_SQL)
def detect_cusip(spark, sf):
    """CUSIP with the context-word boost, after context filter/allow terms."""
    n = D.with_recogniser_spans(N.notes(spark, sf), "text", "context", "rec", raw=True)
    n = n.withColumn("rec", D.filter_recogniser_side(F.col("rec"), F.col("context")))
    return _long(n, "note_id", "rec").filter(F.col("entity_type") == "CUSIP")


_CTX_SQL = _long_sql("SELECT * FROM " + sqlgen.recogniser_spans_sql(NOTES, "note_id", "text", "context"))


@register("context_filter", _CTX_SQL)
def context_filter(spark, sf):
    """Recogniser spans kept for each note's context, minus allow terms."""
    n = D.with_recogniser_spans(N.notes(spark, sf), "text", "context", "rec", raw=True)
    n = n.withColumn("rec", D.filter_recogniser_side(F.col("rec"), F.col("context")))
    return _long(n, "note_id", "rec")


_DETECT_SQL = _long_sql(f"SELECT * FROM {sqlgen.detect_sql(NOTES)}")


@register("detect_only", _DETECT_SQL)
def detect_only(spark, sf):
    """P10: NFC + all layers + merge + allow patterns, no sanitisation."""
    d = D.detect_spans(N.notes(spark, sf), "text", "context", "sp", raw=True)
    return _long(d, "note_id", "sp")


def _merged_only_sql() -> str:
    parts = [sqlgen.spans_union_sql(NOTES, "note_id", "text", catalog.LAYER1_PATTERNS, 0),
             f"SELECT * FROM {sqlgen.recogniser_spans_sql(NOTES, 'note_id', 'text', 'context')}"]
    return sqlgen.merged_sql("\nUNION ALL\n".join(parts))


_MERGE_SQL = _long_sql(f"SELECT * FROM {_merged_only_sql()}")


@register("merge_overlaps", _MERGE_SQL)
def merge_overlaps(spark, sf):
    """M1-M3: union of all sources, sort, greedy fold (before allow-listing)."""
    d = D.detect_spans(N.notes(spark, sf), "text", "context", "sp", raw=True, allow_patterns=())
    return _long(d, "note_id", "sp")


_ALLOW_SQL = (f"SELECT CAST(id AS BIGINT) AS note_id, et AS entity_type, x AS value, CAST(s AS BIGINT) AS pos_start "
              f"FROM {_merged_only_sql()} WHERE {sqlgen.allow_condition('x')}")


@register("allow_patterns", _ALLOW_SQL)
def allow_patterns(spark, sf):
    """Merged winners whose whole text is allow-listed (kept readable)."""
    d = D.detect_spans(N.notes(spark, sf), "text", "context", "sp", raw=True, allow_patterns=())
    kept = d.withColumn("sp", F.filter("sp", lambda s: S.allow_match(s["text"])))
    return _long(kept, "note_id", "sp").select("note_id", "entity_type", "value", "pos_start")


_EFFECT_SQL = f"""SELECT et AS entity_type,
       CAST(sum(CASE WHEN {sqlgen.allow_condition('x')} THEN 1 ELSE 0 END) AS BIGINT) AS n_preserved,
       CAST(sum(CASE WHEN {sqlgen.allow_condition('x')} THEN 0 ELSE 1 END) AS BIGINT) AS n_redacted
FROM {_merged_only_sql()} GROUP BY et"""


@register("allow_effect", _EFFECT_SQL)
def allow_effect(spark, sf):
    """Per type, merged winners preserved by the allow-list vs redacted."""
    d = D.detect_spans(N.notes(spark, sf), "text", "context", "sp", raw=True, allow_patterns=())
    e = explode_rows(d, [], "sp", "s").select(
        F.col("s.entity_type").alias("entity_type"), S.allow_match(F.col("s.text")).alias("allowed"))
    return e.groupBy("entity_type").agg(
        F.sum(F.col("allowed").cast("int")).cast("bigint").alias("n_preserved"),
        F.sum((~F.col("allowed")).cast("int")).cast("bigint").alias("n_redacted"))


# Values for every allow pattern, in SQL that both engines read the same way.
_ALLOW_LISTS = {9: "AGI|MAGI|QBI|RMD|QCD|NUA|IRA|SEP|SIMPLE|401k|403b|457b|529|HSA|FSA|W2|W-2|1099|ROI",
                10: "LTV|DTI|PMI|PITI|MIP|UFMIP|ARM|FRM|HELOC|HEL|LTVX", 11: "TILA|RESPA|ECOA|HMDA|TRID|URLA|QM|ATR|tila",
                12: "DU|LP|AUS|GFE|LE|CD|HUD|CDX", 13: "ALTA|CLTA|CPL|FNMA|FHLMC|GNMA|alta", 14: "VOE|VOD|VOM|VOR|VOX"}
_ALLOW_KINDS = {
    1: "'$' || CAST(price AS STRING) || CASE WHEN k % 3 = 0 THEN 'k' WHEN k % 3 = 1 THEN '.5' ELSE '' END",
    2: "CAST(price % 999 + 1 AS STRING) || ',' || lpad(CAST(k % 1000 AS STRING), 3, '0') || CASE WHEN k % 2 = 0 THEN '.25' ELSE '' END",
    3: "CAST(k % 100 AS STRING) || CASE WHEN k % 2 = 0 THEN '.75 %' ELSE '%' END",
    4: "CAST(k % 40 AS STRING) || '% ' || split_part('bracket|rate|tier|band', '|', CAST(k % 4 + 1 AS INT))",
    5: "CAST(k % 500 AS STRING) || split_part(' bp| bps| basis points|bips', '|', CAST(k % 4 + 1 AS INT))",
    6: "CAST(2000 + k % 110 AS STRING)",
    7: "split_part('age |Age |AGE |aged ', '|', CAST(k % 4 + 1 AS INT)) || CAST(k % 120 AS STRING)",
    8: "split_part('Form |Schedule |IRC |form ', '|', CAST(k % 4 + 1 AS INT)) || CAST(k % 9999 AS STRING)",
} | {i: f"split_part('{v}', '|', CAST(k % {v.count('|') + 1} + 1 AS INT))" for i, v in _ALLOW_LISTS.items()}
_ALLOW_VALUES_SQL = f"""SELECT kind, value, CAST(count(*) AS BIGINT) AS n, bool_and({sqlgen.allow_condition('value')}) AS allowed
FROM ({" UNION ALL ".join(f"SELECT {i} AS kind, {e} || CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END AS value FROM o" for i, e in _ALLOW_KINDS.items())})
GROUP BY kind, value"""


@register("allow_values", f"WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders) {_ALLOW_VALUES_SQL}")
def allow_values(spark, sf):
    """A1-A14 one by one: amounts, rates, years, forms and abbreviations made
    from the orders, with near-misses, against the allow-list."""
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("bigint").alias("price"))
    kinds = ", ".join(f"struct({i} AS kind, {e} || CASE WHEN k % 7 = 0 THEN 'x' ELSE '' END AS value)" for i, e in _ALLOW_KINDS.items())
    v = o.select(F.inline(F.expr(f"array({kinds})")))
    return v.groupBy("kind", "value").agg(F.count("*").cast("bigint").alias("n")).withColumn("allowed", S.allow_match(F.col("value")))


# ---------------------------------------------------------------- gazetteer
def _gazetteer_terms(spark, sf) -> list[str]:
    """Place names from the nation and region dimensions (a fixed list of a few dozen;
    dictionaries that grow go through ``gazetteer.dictionary_spans``)."""
    names = (tables.table(spark, sf, "nation").select(F.col("n_name").alias("t"))
             .unionByName(tables.table(spark, sf, "region").select(F.col("r_name").alias("t"))).distinct())
    return [r.t for r in names.collect() if r.t]


def _gaz_sql() -> str:
    # Same rule in SQL: whole-word, case-insensitive, longest alternative first.
    terms = ("(SELECT DISTINCT t FROM (SELECT n_name AS t FROM nation UNION ALL SELECT r_name FROM region) "
             "WHERE t IS NOT NULL)")
    alt = (f"(SELECT '(?i)()(\\b(?:' || string_agg(regexp_escape(t), '|' ORDER BY length(t) DESC, t) || ')\\b)()' "
           f"AS rx FROM {terms})")
    return f"""SELECT CAST(note_id AS BIGINT) AS note_id, 'LOCATION' AS entity_type, CAST(st AS BIGINT) AS pos_start,
       CAST(st + length(part) AS BIGINT) AS pos_end, 0.85 AS score, part AS value
FROM (SELECT note_id, idx, part, coalesce(sum(length(part)) OVER (PARTITION BY note_id ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
      FROM (SELECT note_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS idx
            FROM (SELECT note_id, string_split_regex(regexp_replace(text, (SELECT rx FROM {alt}),
                         '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '[\\x01\\x02]') AS parts
                  FROM {NOTES})))
WHERE idx % 2 = 0"""


@register("detect_gazetteer", _gaz_sql())
def detect_gazetteer(spark, sf):
    """L2 re-aimed: LOCATION spans from a place-name gazetteer built from the
    nation/region tables (bounded list -> one in-row pattern, no shuffle)."""
    pat = D.gazetteer_pattern(_gazetteer_terms(spark, sf), "LOCATION", 0.85)
    n = S.with_pattern_spans(N.notes(spark, sf), "text", [pat], "sp", source=1, raw=True)
    return _long(n, "note_id", "sp")


# ------------------------------------------------------------ external spans
def _external_spans(spark, sf) -> DataFrame:
    """A model-side span table ``(doc_id, entity_type, start, end, score)``.
    Here it is produced by a separate job (the gazetteer pass written long
    form, tagged with the recogniser type name ``LOCATION``)."""
    pat = D.gazetteer_pattern(_gazetteer_terms(spark, sf), "LOCATION", 0.85)
    n = S.with_pattern_spans(N.notes(spark, sf).select("note_id", "text"), "text", [pat], "sp", source=1, raw=True)
    return explode_rows(n, [F.col("note_id").alias("doc_id")], "sp", "s").select(
        "doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"),
        F.col("s.end").alias("end"), F.col("s.score").alias("score"))


def _ext_sql() -> str:
    gaz = _gaz_sql()
    ext = (f"SELECT note_id AS id, 'LOCATION' AS et, CAST(pos_start AS INTEGER) AS s, CAST(pos_end AS INTEGER) AS e, "
           f"CAST(0.85 AS DOUBLE) AS sc, value AS x, 1 AS src, "
           f"CAST(1000 + row_number() OVER (PARTITION BY note_id ORDER BY pos_start) - 1 AS INTEGER) AS o "
           f"FROM ({gaz})")
    # LOCATION is requested by every context and no allow term is a place name here
    return _long_sql(f"SELECT * FROM {sqlgen.detect_sql(NOTES, extra_rec=ext)}")


@register("spans_external_join", _ext_sql())
def spans_external_join(spark, sf):
    """L2(b): external model spans joined per document, then merged with the
    regex and recogniser layers."""
    docs = attach_external_spans(N.notes(spark, sf).withColumnRenamed("note_id", "doc_id"),
                                 _external_spans(spark, sf), "doc_id", "ext")
    d = D.detect_spans(docs, "text", "context", "sp", raw=True, external_col="ext")
    return _long(d, "doc_id", "sp")


# ------------------------------------------------------------- raw documents
_DOC_PATS = list(catalog.LAYER1_PATTERNS)
_DOC_SQL = _long_sql("\nUNION ALL\n".join(
    sqlgen.pattern_spans_sql("documents", "doc_id", "text", p, 0, catalog.LAYER1_PATTERNS.index(p))
    for p in _DOC_PATS), "doc_id")


@register("detect_documents", _DOC_SQL)
def detect_documents(spark, sf):
    """R0 on the raw corpus: every pattern on whole texts."""
    d = tables.documents(spark, sf)
    n = S.with_pattern_spans(d, "text", _DOC_PATS, "sp", 0, raw=True)  # one scan, all patterns
    return _long(n, "doc_id", "sp", "doc_id")


# ------------------------------------------------------------ request schema
_LANG_CONTEXT = {"en": "general", "fr": "tax_return", "de": "mortgage", "es": "estate_planning"}


def _requests(spark, sf) -> DataFrame:
    """Requests (doc_id, text, context): each document with a context taken
    from its language; Spanish rows carry a context outside the allowed set."""
    ctx = F.create_map(*[F.lit(x) for kv in _LANG_CONTEXT.items() for x in kv])
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return d.select("doc_id", "text", ctx[F.col("lang")].alias("context"))


_REQ_SQL = f"""SELECT CASE WHEN text IS NULL THEN 'missing_text' WHEN length(text) > {catalog.MAX_REQUEST_CHARS}
            THEN 'text_too_long' WHEN coalesce(context, 'general') NOT IN
            ({', '.join(sqlgen.lit(c) for c in catalog.CONTEXT_ENTITIES)}) THEN 'unknown_context' END AS reject_reason,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT text, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANG_CONTEXT.items())} END AS context
      FROM documents)
GROUP BY 1"""


@register("request_schema", _REQ_SQL)
def request_schema(spark, sf):
    """IO2: schema enforcement: accepted (null reason) and quarantined rows, in one scan."""
    return tables.tag_requests(_requests(spark, sf)).groupBy("reject_reason").agg(F.count("*").cast("bigint").alias("n"))


# ------------------------------------------------------- type canonicalisation
_EXT_NAMES = {"EMAIL": "EMAIL_ADDRESS", "US_PHONE": "PHONE_NUMBER", "CREDIT_CARD": "CREDIT_CARD"}


def _model_style_spans(spark, sf) -> DataFrame:
    """A model-style span table over the notes: the spans of every pattern found by
    a separate pass, three types under the recogniser library's names."""
    d = S.with_pattern_spans(N.notes(spark, sf).select("note_id", "text"), "text", catalog.LAYER1_PATTERNS, "sp", 1, raw=True)
    names = F.create_map(*[F.lit(x) for kv in _EXT_NAMES.items() for x in kv])
    return explode_rows(d, [F.col("note_id").alias("doc_id")], "sp", "s").select(
        "doc_id", F.coalesce(names[F.col("s.entity_type")], F.col("s.entity_type")).alias("entity_type"), F.col("s.start").alias("start"),
        F.col("s.end").alias("end"), F.col("s.score").alias("score"))


def _canonical_sql() -> str:
    union = "\nUNION ALL\n".join(sqlgen.pattern_spans_sql(NOTES, "note_id", "text", p, 1, i)
                                 for i, p in enumerate(catalog.LAYER1_PATTERNS))
    own = {p.entity_type for p in catalog.LAYER1_PATTERNS}
    asked = " OR ".join(f"(n.context = {sqlgen.lit(c)} AND u.et IN ({', '.join(sqlgen.lit(t) for t in sorted(_wanted(types) & own)) or 'NULL'}))"
                        for c, types in catalog.CONTEXT_ENTITIES.items())
    terms = ", ".join(sqlgen.lit(t) for t in catalog.ALLOW_TERMS)
    return (f"SELECT CAST(u.id AS BIGINT) AS note_id, u.et AS entity_type, CAST(u.s AS BIGINT) AS pos_start, "
            f"CAST(u.e AS BIGINT) AS pos_end FROM ({union}) u JOIN {NOTES} n ON n.note_id = u.id "
            f"WHERE ({asked}) AND u.x NOT IN ({terms})")


def _wanted(types) -> set[str]:
    """The patterns' own names of the types that a context asks for, by the recogniser library's names."""
    back = {v: k for k, v in _EXT_NAMES.items()}
    return {back.get(t, t) for t in types if t not in _EXT_NAMES or t == _EXT_NAMES[t]}


@register("type_canonical", _canonical_sql())
def type_canonical(spark, sf):
    """L4 (+L9 on pre-canonical names, L10): external spans of all 30 types, of
    which EMAIL_ADDRESS / PHONE_NUMBER come out as EMAIL / US_PHONE, after the
    context filter."""
    docs = attach_external_spans(N.notes(spark, sf).select("note_id", "text", "context"), _model_style_spans(spark, sf), "note_id", "ext")
    rec = D.filter_recogniser_side(D.external_to_spans(F.col("ext"), F.col("text")), F.col("context"))
    out = explode_rows(docs.select("note_id", rec.alias("rec")), ["note_id"], "rec", "s")
    return out.select(F.col("note_id").cast("bigint").alias("note_id"), F.col("s.entity_type").alias("entity_type"),
                      F.col("s.start").cast("bigint").alias("pos_start"), F.col("s.end").cast("bigint").alias("pos_end"))


def _place_terms(spark, sf) -> DataFrame:
    return (tables.table(spark, sf, "nation").select(F.col("n_name").alias("term"))
            .unionByName(tables.table(spark, sf, "region").select(F.col("r_name").alias("term")))
            .filter(F.col("term").isNotNull()).distinct()
            .select("term", F.lit("LOCATION").alias("entity_type"), F.lit(0.85).alias("score")))


def _gaz_join_sql() -> str:
    # every 1..3-word window whose case-folded text is a place name
    words = sqlgen.pattern_spans_sql(NOTES, "note_id", "text", SpanPattern("WORD", r"\w+", 0.0), 1, 0)
    terms = ("(SELECT DISTINCT lower(t) AS key FROM (SELECT n_name AS t FROM nation UNION ALL "
             "SELECT r_name FROM region) WHERE t IS NOT NULL)")
    return f"""WITH w AS (SELECT id, s, e, row_number() OVER (PARTITION BY id ORDER BY s) AS k FROM ({words})),
g AS (SELECT a.id, a.s, b.e FROM w a JOIN w b ON b.id = a.id AND b.k BETWEEN a.k AND a.k + 2),
t AS (SELECT note_id, text FROM {NOTES})
SELECT CAST(g.id AS BIGINT) AS note_id, 'LOCATION' AS entity_type, CAST(g.s AS BIGINT) AS pos_start,
       CAST(g.e AS BIGINT) AS pos_end
FROM g JOIN t ON t.note_id = g.id JOIN {terms} d ON d.key = lower(substring(t.text, g.s + 1, g.e - g.s))"""


@register("detect_gazetteer_join", _gaz_join_sql())
def detect_gazetteer_join(spark, sf):
    """L2 re-aimed, dictionary form: word n-grams joined to the place-name
    table."""
    from ..operators.gazetteer import dictionary_spans
    s = dictionary_spans(N.notes(spark, sf).select("note_id", "text"), _place_terms(spark, sf), "note_id")
    return s.select(F.col("note_id").cast("bigint").alias("note_id"), "entity_type",
                    F.col("start").cast("bigint").alias("pos_start"), F.col("end").cast("bigint").alias("pos_end"))


# --------------------------------------------------------------- best overlaps
@register("merge_best_sets", _long_sql(f"SELECT * FROM {sqlgen.detect_sql(NOTES, merge=sqlgen.best_sql)}"))
def merge_best_sets(spark, sf):
    """M3, strict: overlapping spans resolved by the best non-overlapping set
    (scores, then characters), where the fold would lose a span."""
    d = D.detect_spans(N.notes(spark, sf), "text", "context", "sp", strict=True)
    return _long(d, "note_id", "sp")


# ------------------------------------------------------------------ allow terms
_WORD = SpanPattern("PERSON", r"\w+", 0.85)
_ALLOW_TERMS_SQL = f"""SELECT context, x AS value, CAST(count(*) AS BIGINT) AS n
FROM ({sqlgen.pattern_spans_sql(NOTES, "note_id", "text", _WORD, 1, 0)}) w JOIN {NOTES} n ON n.note_id = w.id
WHERE x NOT IN ({", ".join(sqlgen.lit(t) for t in catalog.ALLOW_TERMS)}) GROUP BY 1, 2"""


@register("allow_terms", _ALLOW_TERMS_SQL)
def allow_terms(spark, sf):
    """A model that takes every word for a person; the allow terms among
    them are not passed on, in any context."""
    notes = N.notes(spark, sf).select("note_id", "text", "context")
    w = S.with_pattern_spans(notes.select("note_id", "text"), "text", [_WORD], "sp", 1, raw=True, gated=False)
    spans = explode_rows(w, [F.col("note_id").alias("doc_id")], "sp", "s").select(
        "doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.score").alias("score"))
    docs = attach_external_spans(notes, spans, "note_id", "ext")
    rec = D.filter_recogniser_side(D.external_to_spans(F.col("ext"), F.col("text")), F.col("context"))
    out = explode_rows(docs.select("context", rec.alias("rec")), ["context"], "rec", "s")
    return out.groupBy("context", F.col("s.text").alias("value")).agg(F.count("*").cast("bigint").alias("n"))


# ------------------------------------------------------------- refused requests
_REFUSED_SQL = f"""SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CASE WHEN t IS NULL THEN 'missing_text' WHEN length(t) > {catalog.MAX_REQUEST_CHARS} THEN 'text_too_long'
            WHEN coalesce(context, 'general') NOT IN ({', '.join(sqlgen.lit(c) for c in catalog.CONTEXT_ENTITIES)}) THEN 'unknown_context' END AS reject_reason,
       CAST(coalesce(length(t), 0) AS BIGINT) AS n_chars
FROM (SELECT doc_id, CASE WHEN n_chars > 20000 THEN repeat(text, 60) WHEN n_chars % 5 > 0 THEN text END AS t,
             CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANG_CONTEXT.items())} END AS context FROM documents)"""


@register("requests_refused", _REFUSED_SQL)
def requests_refused(spark, sf):
    """IO2, every arm: requests without a text, with too long a one, with a
    context outside the set, and those that pass (no reason)."""
    ctx = F.create_map(*[F.lit(x) for kv in _LANG_CONTEXT.items() for x in kv])
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    text = F.when(F.col("n_chars") > 20000, F.repeat("text", 60)).when(F.col("n_chars") % 5 > 0, F.col("text"))
    r = tables.tag_requests(d.select("doc_id", text.alias("text"), ctx[F.col("lang")].alias("context")))
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), "reject_reason", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
