"""DuckDB SQL of the quality rules, stated window by window instead of in arrays."""

from .rules import MEASURES, MIN_ROWS, SPREAD

_G = r"[\x20\x09-\x0D]"
_W = r"[^\x20\x09-\x0D]+"


def _bucket(v: str) -> str:
    return f"CASE WHEN {v} < 32 THEN {v} ELSE 16 + 16 * (length(bin({v})) - 5) + (({v} >> (length(bin({v})) - 5)::INT) - 16) END"


_TOP = "CASE WHEN bucket < 32 THEN bucket ELSE ((17 + (bucket - 16) % 16) << ((bucket - 16) // 16)::INT) - 1 END"


def _measure(e: str) -> str:
    return e.replace(" div ", " // ")


def _fences(keys: str) -> str:
    comma, by = (f"{keys}, ", f"PARTITION BY {keys}, measure") if keys else ("", "PARTITION BY measure")
    return f"""SELECT {comma}measure, max(r) AS r,
        min(top) FILTER (upto * 4 >= r * 3) + greatest({SPREAD} * (min(top) FILTER (upto * 4 >= r * 3) - min(top) FILTER (upto * 4 >= r)), max(slack)) AS fence
      FROM (SELECT *, {_TOP} AS top, sum(n) OVER ({by} ORDER BY bucket) AS upto, sum(n) OVER ({by}) AS r
            FROM (SELECT {comma}measure, slack, bucket, sum(n) AS n FROM sk GROUP BY {comma}measure, slack, bucket))
      GROUP BY {comma}measure"""


OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM d),
win AS (SELECT row, p, array_to_string(words[p:p + 4], ' ') AS g
        FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS p FROM w WHERE len(words) >= 5)),
twice AS (SELECT row, p FROM win QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
rep AS (SELECT row, count(DISTINCT p + k) AS n FROM twice, range(5) t(k) GROUP BY row),
c AS (SELECT w.row, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '{_G}+', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals,
             len(list_distinct(words)) AS n_distinct, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
m AS ({" UNION ALL ".join(f"SELECT row, lang, source, base_failed, '{k}' AS measure, {s} AS slack, ({_measure(e)})::BIGINT AS v FROM b" for k, (e, s) in MEASURES.items())}),
sk AS (SELECT lang, source, measure, slack, {_bucket("v")} AS bucket, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL),
own AS ({_fences("lang, source")}),
byl AS ({_fences("lang")}),
al AS ({_fences("")}),
lim AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.r >= {MIN_ROWS} THEN o.fence WHEN l.r >= {MIN_ROWS} THEN l.fence ELSE a.fence END AS fence
        FROM own o JOIN byl l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN al a ON o.measure = a.measure),
ok AS (SELECT m.row, bool_and(m.v <= lim.fence) AS ok
       FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source AND m.measure = lim.measure
       GROUP BY m.row)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(ok, false) AS kept
FROM b LEFT JOIN ok USING (row)
"""
