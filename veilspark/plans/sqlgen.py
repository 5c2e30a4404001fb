"""DuckDB (RE2) SQL builders for the oracle side of the correctness gate.

These state the same semantics as the Spark operators in plain SQL, so the
two engines can be run side by side: span offsets by the sentinel split plus
window sums, the overlap fold by ``list_reduce``, numbering by window
functions, the splice by an ordered ``string_agg``.  RE2 classes are ASCII
and RE2 has no look-around or possessive quantifiers; where that matters the
builder says so.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from .. import catalog
from ..catalog import SpanPattern
from ..functions import dialect

lit = dialect.sql_literal


def _flags(flags: str, extra: str) -> str:
    f = "".join(dict.fromkeys(extra + flags))
    return f"(?{f})" if f else ""


# RE2 has no possessive quantifiers.  For the parcel pattern the possessive
# tail changes matches: the run of [-A-Z0-9./] is taken whole and must then
# sit on a word boundary, so a value is never shortened to end before a
# trailing '.', '-' or '/'.  Equivalent RE2 (for ASCII text): the maximal run
# must end in a letter or digit and be followed by a non-run, non-word char.
_PARCEL = next(p for p in catalog.LAYER1_PATTERNS if p.entity_type == "PARCEL_NUMBER")
_RE2_VALUE_OVERRIDES = {
    _PARCEL.regex: ("[A-Z0-9][-A-Z0-9./]{3,23}[A-Z0-9]", "(?:$|[^-A-Za-z0-9./_])"),
}


def re2_three(p: SpanPattern, extra_flags: str = "") -> str:
    flags, pre, val, post = dialect.three_group_parts(p.regex, p.group)
    val2, post2 = dialect.re2(val), dialect.re2(post)
    if p.regex in _RE2_VALUE_OVERRIDES:
        val2, post2 = _RE2_VALUE_OVERRIDES[p.regex]
    return f"{_flags(flags, extra_flags)}({dialect.re2(pre)})({val2})({post2})"


def re2_full(p: str) -> str:
    flags, body = dialect.split_flags(p)
    return f"{_flags(flags, '')}{dialect.re2(body)}"


def pattern_spans_sql(src: str, id_col: str, text_col: str, p: SpanPattern, source: int, ord_: int,
                      extra_flags: str = "") -> str:
    """SELECT id, et, s, e, sc, x, src, o for every match of one pattern."""
    rx = re2_three(p, extra_flags)
    return f"""SELECT {id_col} AS id, {lit(p.entity_type)} AS et, CAST(st AS INTEGER) AS s,
       CAST(st + length(part) AS INTEGER) AS e, CAST({p.score!r} AS DOUBLE) AS sc, part AS x,
       {source} AS src, {ord_} AS o
FROM (SELECT {id_col}, idx, part,
             coalesce(sum(length(part)) OVER (PARTITION BY {id_col} ORDER BY idx
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
      FROM (SELECT {id_col}, unnest(parts) AS part, generate_subscripts(parts, 1) AS idx
            FROM (SELECT {id_col}, string_split_regex(regexp_replace({text_col}, {lit(rx)},
                         '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '[\\x01\\x02]') AS parts
                  FROM {src})))
WHERE idx % 2 = 0"""


def spans_union_sql(src: str, id_col: str, text_col: str, patterns: Sequence[SpanPattern], source: int,
                    ord_offset: int = 0, extra_flags: str = "") -> str:
    return "\nUNION ALL\n".join(pattern_spans_sql(src, id_col, text_col, p, source, ord_offset + i, extra_flags)
                                for i, p in enumerate(patterns))


def recogniser_spans_sql(src: str, id_col: str, text_col: str, context_col: str) -> str:
    """Layer 3 with the recogniser flags, CUSIP context boost, same-type
    containment de-duplication, context filter and allow terms."""
    raw = spans_union_sql(src, id_col, text_col, catalog.LAYER3_PATTERNS, 1, 0, "ism")
    words = "[" + ", ".join(lit(w) for w in catalog.CUSIP_CONTEXT_WORDS) + "]"
    ctx_rows = ", ".join(f"({lit(c)}, {lit(t)})" for c, ts in catalog.CONTEXT_ENTITIES.items() for t in ts)
    terms = ", ".join(lit(t) for t in catalog.ALLOW_TERMS)
    return f"""(WITH r0 AS ({raw}),
r1 AS (SELECT r0.id, r0.et, r0.s, r0.e, r0.x, r0.src, r0.o,
              CASE WHEN r0.et = 'CUSIP' AND list_has_any(
                       list_slice(w, greatest(len(w) - 4, 1), len(w)), {words})
                   THEN least(1.0, greatest(r0.sc + 0.35, 0.4)) ELSE r0.sc END AS sc
       FROM r0 JOIN (SELECT {id_col} AS id, {text_col} AS t FROM {src}) tt ON tt.id = r0.id,
            LATERAL (SELECT regexp_extract_all(lower(substring(tt.t, 1, r0.s)), '\\w+') AS w)),
r2 AS (SELECT * FROM r1 a WHERE NOT EXISTS (
         SELECT 1 FROM r1 b WHERE b.id = a.id AND b.et = a.et AND b.s <= a.s AND b.e >= a.e
           AND (b.sc > a.sc OR (b.sc = a.sc AND (b.s < a.s OR b.e > a.e))))),
ctx(c, t) AS (VALUES {ctx_rows})
SELECT r2.id, r2.et, r2.s, r2.e, r2.sc, r2.x, r2.src, r2.o FROM r2
JOIN (SELECT {id_col} AS id, CASE WHEN {context_col} IN (SELECT DISTINCT c FROM ctx) THEN {context_col}
                                  ELSE 'general' END AS c FROM {src}) cc ON cc.id = r2.id
JOIN ctx ON ctx.c = cc.c AND ctx.t = r2.et
WHERE r2.x NOT IN ({terms}))"""


def merged_sql(spans: str) -> str:
    """Overlap fold per id; returns (id, s, e, sc, src, o, et, x) kept spans."""
    core = "{'s': s, 'e': e, 'sc': sc, 'src': src, 'o': o, 'et': et, 'x': x}"
    step = ("lambda acc, y: CASE WHEN len(acc.k) > 0 AND y.k[1].s < acc.k[-1].e THEN "
            "CASE WHEN y.k[1].sc > acc.k[-1].sc OR (y.k[1].sc = acc.k[-1].sc AND "
            "y.k[1].e - y.k[1].s > acc.k[-1].e - acc.k[-1].s) "
            "THEN {'k': list_concat(list_slice(acc.k, 1, len(acc.k) - 1), y.k)} ELSE acc END "
            "ELSE {'k': list_concat(acc.k, y.k)} END")
    return f"""(SELECT id, kept.s AS s, kept.e AS e, kept.sc AS sc, kept.src AS src, kept.o AS o,
        kept.et AS et, kept.x AS x
 FROM (SELECT id, unnest(list_reduce(l, {step}).k) AS kept
       FROM (SELECT id, list({{'k': [{core}]}} ORDER BY s, -sc, src, o, e, et, sc, x) AS l
             FROM ({spans}) GROUP BY id)))"""


def best_sql(spans: str) -> str:
    """The best non-overlapping set per id (largest score, then most characters):
    dynamic programming over the spans by their ends; columns as ``merged_sql``."""
    core = "{'s': s, 'e': e, 'sc': sc, 'src': src, 'o': o, 'et': et, 'x': x}"
    none = "{'s': 0, 'e': 0, 'sc': 0.0::DOUBLE, 'src': 0, 'o': 0, 'et': '', 'x': ''}"
    first = "{'e': -1::BIGINT, 'sc': 0.0::DOUBLE, 'ch': 0::BIGINT, 'kept': list_filter([" + none + "], lambda q: false)}"
    before = "list_filter(acc.dp, lambda t: t.e <= y.y.s)[-1]"
    with_ = f"round({before}.sc + y.y.sc, 9)"
    chars = f"({before}.ch + y.y.e - y.y.s)"
    better = f"({with_} > acc.dp[-1].sc OR ({with_} = acc.dp[-1].sc AND {chars} > acc.dp[-1].ch))"
    step = (f"lambda acc, y: {{'dp': list_append(acc.dp, CASE WHEN {better} THEN {{'e': y.y.e::BIGINT, 'sc': {with_}, 'ch': {chars}::BIGINT, "
            f"'kept': list_append({before}.kept, y.y)}} ELSE {{'e': y.y.e::BIGINT, 'sc': acc.dp[-1].sc, 'ch': acc.dp[-1].ch, 'kept': acc.dp[-1].kept}} END), 'y': y.y}}")
    return f"""(SELECT id, kept.s AS s, kept.e AS e, kept.sc AS sc, kept.src AS src, kept.o AS o,
        kept.et AS et, kept.x AS x
 FROM (SELECT id, unnest(list_reduce(list_prepend(l[1], l), {step}).dp[-1].kept) AS kept
       FROM (SELECT id, list({{'dp': [{first}], 'y': {core}}} ORDER BY e, s, -sc, src, o, et, x) AS l
             FROM ({spans}) GROUP BY id)))"""


def allow_condition(x: str) -> str:
    return "(" + " OR ".join(f"regexp_full_match({x}, {lit(re2_full(p))})" for p in catalog.ALLOW_PATTERNS) + ")"


def detect_sql(src: str, id_col: str = "note_id", text_col: str = "text", context_col: str = "context",
               layer3: bool = True, extra_rec: str | None = None, merge: Callable[[str], str] = merged_sql) -> str:
    """Merged, allow-filtered spans (id, s, e, sc, src, o, et, x)."""
    parts = [spans_union_sql(src, id_col, text_col, catalog.LAYER1_PATTERNS, 0)]
    if layer3:
        parts.append(f"SELECT * FROM {recogniser_spans_sql(src, id_col, text_col, context_col)}")
    if extra_rec:
        parts.append(extra_rec)
    spans = "\nUNION ALL\n".join(parts)
    return f"(SELECT * FROM {merge(spans)} WHERE NOT {allow_condition('x')})"


def entries_sql(detected: str) -> str:
    """Manifest entries (id, s, e, et, x, placeholder) in reading order."""
    return f"""(WITH d AS (SELECT * FROM {detected}),
f AS (SELECT id, x, arg_min(et, s) AS fet, min(s) AS fs FROM d GROUP BY id, x),
n AS (SELECT id, x, fet, row_number() OVER (PARTITION BY id, fet ORDER BY fs) AS num FROM f)
SELECT d.id, d.s, d.e, d.et, d.x, '<' || n.fet || '_' || CAST(n.num AS VARCHAR) || '>' AS ph
FROM d JOIN n ON n.id = d.id AND n.x = d.x)"""


def splice_sql(src: str, id_col: str, text_col: str, entries: str) -> str:
    """(id, text, sanitized, n_entities) for every source row."""
    return f"""(WITH en AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS pe FROM {entries}),
agg AS (SELECT en.id, string_agg(substring(t.{text_col}, en.pe + 1, en.s - en.pe) || en.ph, '' ORDER BY en.s) AS body,
               max(en.e) AS last_e, count(*) AS n
        FROM en JOIN {src} t ON t.{id_col} = en.id GROUP BY en.id)
SELECT t.{id_col} AS id, t.{text_col} AS text,
       CASE WHEN agg.id IS NULL THEN t.{text_col} ELSE agg.body || substring(t.{text_col}, agg.last_e + 1) END
         AS sanitized,
       CAST(coalesce(agg.n, 0) AS BIGINT) AS n_entities
FROM {src} t LEFT JOIN agg ON agg.id = t.{id_col})"""


# ------------------------------------------------------------------ sanitise
def _rr(expr: str, pattern: str, rep: str, flags: str = "") -> str:
    rx = re2_full((f"(?{flags})" if flags else "") + pattern)
    return f"regexp_replace({expr}, {lit(rx)}, {lit(rep)}, 'g')"


def base64_sql(expr: str) -> str:
    """V5 without look-around: the block must sit between non-word
    characters or text ends.  (Approximation: blocks sharing one boundary
    character, and backtracking into '+'/'/', are not modelled.)"""
    rx = r"(^|[^\w])[A-Za-z0-9+/]{200,}={0,2}($|[^\w])"
    return f"regexp_replace({expr}, {lit(rx)}, '\\1' || {lit(catalog.BASE64_REPLACEMENT)} || '\\2', 'g')"


def sanitize_step_fns():
    """[(label, fn(text sql) -> rewritten text sql)] in application order."""
    return [
        ("stripped_control_chars", lambda e: _rr(e, catalog.CONTROL_CHARS, "")),
        ("stripped_invisible_unicode", lambda e: _rr(e, catalog.INVISIBLE_UNICODE, "")),
        ("removed_base64_blocks", base64_sql),
        ("removed_script_elements", lambda e: _rr(e, catalog.HTML_SCRIPT, "", "is")),
        ("removed_html_tags", lambda e: _rr(e, catalog.HTML_TAG, "")),
        ("removed_external_images", lambda e: _rr(e, catalog.MD_EXTERNAL_IMAGE, catalog.IMAGE_REPLACEMENT)),
        ("normalized_whitespace", lambda e: _rr(_rr(e, catalog.EXCESSIVE_BLANKS, "\n\n\n"),
                                                catalog.EXCESSIVE_SPACES, " ")),
    ]


def sanitize_chain_sql(src: str, id_col: str, text_col: str) -> str:
    """(id, t0..t7, actions): one nested SELECT per step so each step's text
    is computed once and compared with the previous one."""
    q = f"SELECT {id_col} AS id, {text_col} AS t0 FROM {src}"
    steps = sanitize_step_fns()
    for k, (_label, fn) in enumerate(steps, start=1):
        q = f"SELECT *, {fn(f't{k - 1}')} AS t{k} FROM ({q})"
    labels = ", ".join(f"CASE WHEN t{k} <> t{k - 1} THEN {lit(lab)} END"
                       for k, (lab, _fn) in enumerate(steps, start=1))
    return f"(SELECT *, list_filter([{labels}], lambda a: a IS NOT NULL) AS actions FROM ({q}))"


# ------------------------------------------------------------------ injection
def injection_sql(expr: str) -> tuple[str, str]:
    """(labels list sql, score sql) over lower(expr)."""
    low = f"lower({expr})"
    labs = ", ".join(f"CASE WHEN regexp_matches({low}, {lit(re2_full('(?i)' + r.regex))}) THEN {lit(r.label)} END"
                     for r in catalog.INJECTION_RULES)
    ws = ", ".join(f"CASE WHEN regexp_matches({low}, {lit(re2_full('(?i)' + r.regex))}) THEN {r.weight!r} ELSE 0.0 END"
                   for r in catalog.INJECTION_RULES)
    return f"list_filter([{labs}], lambda a: a IS NOT NULL)", f"round(greatest({ws}), 2)"
