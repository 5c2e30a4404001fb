"""Input sanitisation (V1-V10): size rejection, then seven ordered rewrites.

Each rewrite is a JVM ``regexp_replace``; its action label is recorded only
if that step changed the text.  Every step is its own projection so the
previous text is computed once and read twice (rewrite + change test).
A rewrite is skipped where the text lacks a literal that every match contains,
or is ASCII where every match is not; ASCII rows run it without its Unicode flag.
Rejected rows keep their unmodified text, no actions and an ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions import dialect


def steps() -> list[tuple[str, list[tuple[str, str]]]]:
    """(action label, [(java regex, replacement), ...]) in application order."""
    j = dialect.java
    return [
        ("stripped_control_chars", [(j(catalog.CONTROL_CHARS), "")]),
        ("stripped_invisible_unicode", [(j(catalog.INVISIBLE_UNICODE), "")]),
        ("removed_base64_blocks", [(j(catalog.BASE64_BLOCK), catalog.BASE64_REPLACEMENT)]),
        ("removed_script_elements", [(j(catalog.HTML_SCRIPT, "is"), "")]),
        ("removed_html_tags", [(j(catalog.HTML_TAG), "")]),
        ("removed_external_images", [(j(catalog.MD_EXTERNAL_IMAGE), catalog.IMAGE_REPLACEMENT)]),
        ("normalized_whitespace", [(j(catalog.EXCESSIVE_BLANKS), "\n\n\n"), (j(catalog.EXCESSIVE_SPACES), " ")]),
    ]


# Catalogue regex -> a literal that each of its matches contains.
_LITERALS = {catalog.HTML_SCRIPT: "<", catalog.HTML_TAG: "<", catalog.MD_EXTERNAL_IMAGE: "![", catalog.EXCESSIVE_BLANKS: "\n\n\n\n"}
_BEYOND_ASCII = {catalog.INVISIBLE_UNICODE}


def _rewrite(text: Column, is_ascii: Column, rx: str, rep: str) -> Column:
    """``regexp_replace`` behind the tests that tell that it changes nothing."""
    body = dialect.split_flags(rx)[1]
    out = F.regexp_replace(text, rx, rep)
    if body in _BEYOND_ASCII:
        return F.when(is_ascii, text).otherwise(out)
    plain = dialect.ascii_java(rx, rx)
    if plain:
        out = F.when(is_ascii, F.regexp_replace(text, plain, rep)).otherwise(out)
    return F.when(text.contains(_LITERALS[body]), out).otherwise(text) if body in _LITERALS else out


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def rejection(text: Column, max_bytes: int | None = catalog.MAX_INPUT_BYTES,
              max_lines: int | None = catalog.MAX_LINE_COUNT) -> Column:
    """V1/V2: error message or null (byte test first, as specified); a limit of None is off."""
    return (F.when(F.lit(max_bytes is not None) & (F.octet_length(text) > (max_bytes or 0)), F.lit(catalog.ERROR_TOO_LARGE))
            .when(F.lit(max_lines is not None) & (newline_count(text) >= (max_lines or 0)), F.lit(catalog.ERROR_TOO_MANY_LINES)))


def sanitize(df: DataFrame, text_col: str = "text", max_bytes: int | None = catalog.MAX_INPUT_BYTES,
             max_lines: int | None = catalog.MAX_LINE_COUNT) -> DataFrame:
    """Replaces ``text_col`` with the cleaned text and adds ``is_valid``,
    ``error`` and ``actions``.

    Invalid rows pass through unchanged so callers can split them off
    (``filter("is_valid")``) instead of losing them.
    """
    others = [c for c in df.columns if c != text_col]
    # the rewrites put ASCII only, so a text that is ASCII stays it
    staged = df.select(*others, rejection(F.col(text_col), max_bytes, max_lines).alias("error"),
                       (F.octet_length(text_col) == F.length(text_col)).alias("__ascii"), F.col(text_col).alias("__san_0"))
    flags: list[str] = []
    cur = "__san_0"
    for k, (label, rewrites) in enumerate(steps(), start=1):
        expr = F.col(cur)
        for rx, rep in rewrites:
            expr = _rewrite(expr, F.col("__ascii"), rx, rep)
        expr = F.when(F.col("error").isNull(), expr).otherwise(F.col(cur))  # rejected rows untouched
        nxt, flag = f"__san_{k}", f"__flag_{k}"
        keep = [c for c in staged.columns if c != cur]
        staged = (staged.select(*keep, F.col(cur), expr.alias(nxt))
                  .select(*keep, nxt, F.when(F.col(nxt) != F.col(cur), F.lit(label)).alias(flag)))
        flags.append(flag)
        cur = nxt
    return staged.select(
        *others,
        F.col(cur).alias(text_col),
        F.col("error").isNull().alias("is_valid"),
        F.array_compact(F.array(*[F.col(f) for f in flags])).alias("actions"),
        "error",
    )
