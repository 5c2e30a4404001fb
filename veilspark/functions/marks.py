"""Pattern spans of ASCII rows by Arrow's regex kernels.

Java's matcher costs some 15 microseconds for each pattern and note; RE2 with its
automata takes about a tenth.  On plain ASCII text it finds the same matches,
for patterns that ``re2_marks`` can write in its syntax.  All other rows and
patterns stay with Java (``functions.spans``).

The work is done for a whole Arrow batch: one scan says which rows a pattern
matches, those are marked and split as in ``functions.spans``, and the offsets of
all parts come from one running sum.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import catalog
from ..catalog import SpanPattern
from . import dialect

SENTINEL = "\u0001"
_MARKS = f"\\1{SENTINEL}\\2{SENTINEL}\\3"

# What both engines read alike on ASCII text: these escapes, escaped punctuation,
# groups that do not repeat, plain classes and counts.
_LETTER_ESCAPES = set("bdDwWsSnrt")
_OTHER_SYNTAX = re.compile(r"\(\?(?!:)|[*+?}]\+|\)[*+{]|\[\^?\]|\[[^\]]*\[|&&|\{(?!\d+(?:,\d*)?\})")


def _possessive_free() -> dict[str, tuple[str, str]]:
    """The two patterns with possessive quantifiers, in forms without.

    An address's possessive parts are followed by characters that they cannot hold,
    so giving back changes nothing.  A parcel's value takes as many characters as it
    can, 25 at most, before its border is tested: 25 and a border, or fewer up to a
    character outside its class that makes one.  No match starts at that character."""
    by_type = {p.entity_type: p for p in catalog.LAYER1_PATTERNS}
    street, parcel = by_type["STREET_ADDRESS"].regex, by_type["PARCEL_NUMBER"].regex
    flags, pre, _, _ = dialect.three_group_parts(parcel, 1)
    c = "[-A-Z0-9./]"
    fewer = f"([A-Z0-9]{c}{{3,22}}[A-Z0-9])([^-A-Z0-9./_]|\\z)|([A-Z0-9]{c}{{3,22}}[-./])(_)"
    return {street: (f"(?i)()({dialect.re2(dialect.split_flags(street)[1])})()", _MARKS),
            parcel: (f"(?{flags})({dialect.re2(pre)})(?:([A-Z0-9]{c}{{24}})\\b|{fewer})", f"\\1{SENTINEL}\\2\\3\\5{SENTINEL}\\4\\6")}


_FORMS = _possessive_free()


@functools.cache
def re2_marks(pattern: str, group: int) -> tuple[str, str] | None:
    """(RE2 pattern, replacement) that brackets every value, or None where the
    engines may differ on ASCII text."""
    if pattern in _FORMS:
        return _FORMS[pattern]
    flags, pre, val, post = dialect.three_group_parts(pattern, group)
    body = pre + val + post
    bare = re.sub(r"\\(.)", lambda m: "x" if m.group(1) in _LETTER_ESCAPES or not m.group(1).isalnum() else "&&", body, flags=re.S)
    outside = re.sub(r"\[[^\]]*\]", "x", bare)
    if not pattern.isascii() or set(flags) - set("ism") or _OTHER_SYNTAX.search(bare) or re.search(r"[\^$]", outside):
        return None
    form = f"{f'(?{flags})' if flags else ''}({pre})({val})({post})"
    try:
        pc.replace_substring_regex(pa.array([""]), pattern=form, replacement=_MARKS)
    except pa.ArrowInvalid:
        return None
    return form, _MARKS


def readable(patterns: Sequence[SpanPattern]) -> list[int]:
    """Places of the patterns that ``re2_marks`` can write."""
    return [i for i, p in enumerate(patterns) if re2_marks(p.regex, p.group)]


def plain(text: Column) -> Column:
    """Rows for RE2: ASCII without the sentinel and without the vertical tab, which
    only Java counts as white space."""
    return F.coalesce((F.octet_length(text) == F.length(text)) & ~text.contains(SENTINEL) & ~text.contains("\u000b"), F.lit(False))


def _values(text: pa.Array, form: str, marks: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array] | None:
    """(row, start, end, value) of each match, by row and start."""
    hit = np.flatnonzero(pc.fill_null(pc.match_substring_regex(text, pattern=form), False).to_numpy(zero_copy_only=False))
    if not len(hit):
        return None
    parts = pc.split_pattern(pc.replace_substring_regex(text.take(pa.array(hit)), pattern=form, replacement=marks), pattern=SENTINEL)
    at, flat = parts.offsets.to_numpy(), parts.values
    sizes = pc.binary_length(flat).to_numpy()
    begins, counts = np.cumsum(sizes) - sizes, np.diff(at)
    first = np.repeat(at[:-1], counts)
    value = np.flatnonzero((np.arange(len(sizes)) - first) % 2 == 1)
    start = begins[value] - begins[first[value]]
    return np.repeat(hit, counts)[value], start, start + sizes[value], flat.take(pa.array(value))


def spans_of(patterns: Sequence[SpanPattern], ords: Sequence[int], source: int, span_type: T.StructType):
    """Arrow UDF: text -> spans of all patterns, in their order; null for a null."""
    forms = [re2_marks(p.regex, p.group) for p in patterns]
    types, scores = [p.entity_type for p in patterns], [float(p.score) for p in patterns]
    ords = list(ords)
    kind = to_arrow_type(T.ArrayType(span_type))
    fields = [kind.value_type.field(i) for i in range(kind.value_type.num_fields)]

    def spans(text: pa.Array) -> pa.Array:
        wide = text.cast(pa.large_string())
        got = [(k, v) for k, (form, marks) in enumerate(forms) if (v := _values(wide, form, marks))]
        put = lambda i: np.concatenate([v[i] for _, v in got]) if got else np.empty(0, "int64")
        row, start, end = put(0), put(1), put(2)
        which = np.repeat(np.array([k for k, _ in got], "int64"), [len(v[0]) for _, v in got])
        value = pa.chunked_array([v[3] for _, v in got], pa.large_string()).combine_chunks() if got else pa.array([], pa.large_string())
        order = np.argsort(row, kind="stable")
        which, score = which[order], np.array(scores, "float64")[which[order]]
        columns = {"start": start[order], "nscore": -score, "source": np.full(len(order), source), "ord": np.array(ords, "int64")[which], "end": end[order],
                   "entity_type": pa.array(types, pa.string()).take(pa.array(which)), "score": score, "text": value.take(pa.array(order))}
        flat = pa.StructArray.from_arrays([pa.array(columns[f.name]).cast(f.type) for f in fields], fields=fields)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(text)))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), flat, type=kind, mask=pc.is_null(text))

    return F.arrow_udf(spans, T.ArrayType(span_type))
