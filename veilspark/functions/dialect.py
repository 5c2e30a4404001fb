"""Regex dialect translation.

Catalogue patterns are written in Python-regex syntax.  Spark evaluates regexes
with ``java.util.regex``; two flags make Java agree with Python on text:

* ``U`` (UNICODE_CHARACTER_CLASS): Unicode ``\\b \\w \\d \\s`` and Unicode case
  folding, as Python ``str`` patterns have by default;
* ``d`` (UNIX_LINES): ``.`` excludes only LF, as in Python.

The span operators also need the value of each match and its offset, which
Spark's regex functions do not report.  ``three_group_java`` rewrites a
pattern into ``(prefix)(value)(suffix)`` so a single ``regexp_replace`` can
bracket every value with sentinels (see ``functions.spans``).

``re2`` produces the closest RE2 form for the DuckDB oracle (possessive
quantifiers dropped, ``\\uXXXX`` escapes rewritten).  RE2 classes are ASCII,
so oracle checks are only exact on inputs where that makes no difference.
"""

from __future__ import annotations

import re

import regex

_LEADING_FLAGS = re.compile(r"^\(\?([a-zA-Z]+)\)")


def split_flags(pattern: str) -> tuple[str, str]:
    """Return (inline flags at the very start, rest of pattern)."""
    m = _LEADING_FLAGS.match(pattern)
    if not m:
        return "", pattern
    return m.group(1), pattern[m.end():]


def _scan_groups(pattern: str) -> list[tuple[int, int, bool]]:
    """(open index, close index, capturing) for every parenthesised group."""
    groups: list[tuple[int, int, bool]] = []
    stack: list[tuple[int, bool]] = []
    i, n, in_class = 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            i += 1
            continue
        if c == "[":
            in_class = True
            # a ']' right after '[' or '[^' is literal
            j = i + 1
            if j < n and pattern[j] == "^":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            i = j
            continue
        if c == "(":
            stack.append((i, not pattern.startswith("(?", i)))
        elif c == ")":
            start, capturing = stack.pop()
            groups.append((start, i, capturing))
        i += 1
    if stack:
        raise ValueError(f"unbalanced pattern: {pattern!r}")
    return sorted(groups)


def _uncapture(pattern: str, keep: int | None = None) -> str:
    """Turn every capturing group except the one opening at ``keep`` into ``(?:``."""
    out = pattern
    for start, _end, capturing in sorted(_scan_groups(pattern), reverse=True):
        if capturing and start != keep:
            out = out[: start + 1] + "?:" + out[start + 1:]
    return out


_BACK_REFERENCE = re.compile(r"(?<!\\)(?:\\\\)*\\[1-9]|\(\?P=|\\g<|\\k<")


def validate(pattern: str, group: int) -> None:
    """Refuse what the rewrite around the value cannot express: patterns that
    do not compile, back-references (group numbers change) and a value group
    that is itself repeated (only its last turn would be the value)."""
    regex.compile(pattern)
    _, body = split_flags(pattern)
    if _BACK_REFERENCE.search(body):
        raise ValueError(f"back-references are not supported: {pattern!r}")
    caps = [g for g in _scan_groups(body) if g[2]]
    if group and len(caps) >= group:
        after = body[caps[group - 1][1] + 1:][:1]
        if after and after in "*+?{":
            raise ValueError(f"the value group may not be repeated: {pattern!r}")


def three_group_parts(pattern: str, group: int) -> tuple[str, str, str, str]:
    """Split a pattern into (flags, prefix, value, suffix) around its value.

    ``group`` = 0: the whole match is the value.  ``group`` = 1: the value is
    the first capturing group; all other capturing groups become non-capturing.
    """
    validate(pattern, group)
    flags, body = split_flags(pattern)
    if group == 0:
        return flags, "", _uncapture(body), ""
    caps = [g for g in _scan_groups(body) if g[2]]
    if not caps:
        raise ValueError(f"group {group} requested but pattern has none: {pattern!r}")
    start, end, _ = caps[group - 1]
    pre, val, post = body[:start], body[start + 1: end], body[end + 1:]
    return flags, _uncapture(pre), _uncapture(val), _uncapture(post)


def java_flags(flags: str, extra: str = "") -> str:
    wanted = "Ud" + extra + flags
    seen = "".join(dict.fromkeys(wanted))
    return f"(?{seen})"


def java(pattern: str, extra_flags: str = "") -> str:
    """Python-dialect pattern -> Java pattern with Python-compatible flags."""
    flags, body = split_flags(pattern)
    return java_flags(flags, extra_flags) + body


def three_group_java(pattern: str, group: int, lookahead: str | None = None) -> str:
    flags, pre, val, post = three_group_parts(pattern, group)
    return f"{java_flags(flags)}{lookahead or ''}({pre})({val})({post})"


# Escapes that may name a character or a class beyond ASCII.
_BEYOND_ASCII = re.compile(r"\\[xuUNpP0c]")


def ascii_java(java_pattern: str, pattern: str) -> str | None:
    """``java_pattern`` without the Unicode flag, whose classes, borders and case
    folding cost more: on ASCII text it matches the same, as long as the
    catalogue ``pattern`` names ASCII characters only (else None)."""
    if not pattern.isascii() or _BEYOND_ASCII.search(pattern) or not java_pattern.startswith("(?Ud"):
        return None
    return java_pattern.replace("(?Ud", "(?d", 1)


def java_fullmatch(pattern: str) -> str:
    """Anchored whole-string form (``re.fullmatch``)."""
    flags, body = split_flags(pattern)
    return f"{java_flags(flags)}\\A(?:{body})\\z"


# --------------------------------------------------------------------------- RE2
_POSSESSIVE = re.compile(r"(?<!\\)([+*?}])\+")
_U_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def re2(pattern: str) -> str:
    """Best-effort RE2 form of a Python-dialect pattern (oracle use only)."""
    out = _U_ESCAPE.sub(lambda m: "\\x{" + m.group(1) + "}", pattern)
    out = _POSSESSIVE.sub(r"\1", out)
    out = out.replace("\\'", "'")
    return out


def three_group_re2(pattern: str, group: int) -> str:
    flags, pre, val, post = three_group_parts(pattern, group)
    prefix = f"(?{flags})" if flags else ""
    return f"{prefix}({re2(pre)})({re2(val)})({re2(post)})"


def sql_literal(s: str) -> str:
    """Single-quoted SQL string literal (both Spark and DuckDB)."""
    return "'" + s.replace("'", "''") + "'"
