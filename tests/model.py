"""What the operators have to give, for one text at a time.

Written from the specification's statements, not from any implementation:
overlaps are settled champion by champion over position-sorted spans,
placeholder numbers are ranks among first occurrences, texts are put together
from what lies between spans, steps and rules are data.  Only tests use it, on
small inputs.  Patterns run in Python's own ``regex``/``re``, so the Java
translation is checked too.
"""

import hashlib
import re
import unicodedata
from collections import Counter
from itertools import groupby

import regex

from veilspark import catalog

RECOGNISER_FLAGS = regex.DOTALL | regex.MULTILINE | regex.IGNORECASE


# ------------------------------------------------------------------ detection
def _found(text, patterns, source, flags=0):
    """All spans of a list of patterns; a pattern's value group narrows its span."""
    for rank, p in enumerate(patterns):
        for hit in regex.finditer(p.regex, text, flags):
            part = p.group if source == 0 and p.group and hit.lastindex else 0
            a, z = hit.span(part)
            yield {"entity_type": p.entity_type, "start": a, "end": z, "score": p.score, "text": text[a:z], "source": source, "ord": rank}


def spans_layer1(text):
    return list(_found(text, catalog.LAYER1_PATTERNS, 0))


def _boosted(span, text):
    """A CUSIP gains .35 (to .4 at least, 1 at most) if one of the five words before it is a context word."""
    near = regex.findall(r"\w+", text[:span["start"]].lower())[-5:]
    if span["entity_type"] != "CUSIP" or not set(near).intersection(catalog.CUSIP_CONTEXT_WORDS):
        return span
    return span | {"score": min(1.0, max(0.4, span["score"] + 0.35))}


def _covers(big, small):
    """``big`` makes ``small`` of the same type superfluous."""
    inside = big["start"] <= small["start"] and small["end"] <= big["end"] and big["entity_type"] == small["entity_type"]
    longer = (big["start"], big["end"]) != (small["start"], small["end"])
    return inside and (big["score"] > small["score"] or (big["score"] == small["score"] and longer))


def spans_layer3(text, context):
    spans = [_boosted(s, text) for s in _found(text, catalog.LAYER3_PATTERNS, 1, RECOGNISER_FLAGS)]
    asked = catalog.CONTEXT_ENTITIES.get(context) or catalog.CONTEXT_ENTITIES["general"]
    return [s | {"entity_type": catalog.TYPE_MAP.get(s["entity_type"], s["entity_type"])} for s in spans
            if not any(_covers(b, s) for b in spans) and s["entity_type"] in asked and s["text"] not in catalog.ALLOW_TERMS]


def merge(spans):
    """Champions: from left to right, a span is challenged by those that start
    before it ends; a challenger with the larger (score, length) takes its place."""
    waiting = sorted(spans, key=lambda s: (s["start"], -s["score"], s["source"], s["ord"]))
    might = lambda s: (s["score"], s["end"] - s["start"])
    champions = []
    while waiting:
        champion, rest = waiting[0], 1
        while rest < len(waiting) and waiting[rest]["start"] < champion["end"]:
            champion = max(champion, waiting[rest], key=might)  # the first of equals stays
            rest += 1
        champions.append(champion)
        waiting = waiting[rest:]
    return champions


def allowed(text):
    return any(re.fullmatch(p, text) for p in catalog.ALLOW_PATTERNS)


def detect(text, context="general", layer3=True):
    text = unicodedata.normalize("NFC", text)
    candidates = spans_layer1(text) + (spans_layer3(text, context) if layer3 else [])
    return [s for s in merge(candidates) if not allowed(s["text"])]


# ------------------------------------------------------------------ redaction
def redact(text, context="general", layer3=True):
    """(sanitized, entries, normalised text)."""
    text = unicodedata.normalize("NFC", text)
    spans = detect(text, context, layer3)
    values = [s["text"] for s in spans]
    heads = [i for i, v in enumerate(values) if values.index(v) == i]
    kinds = [spans[i]["entity_type"] for i in heads]
    name = {values[i]: f"<{kinds[k]}_{Counter(kinds[:k + 1])[kinds[k]]}>" for k, i in enumerate(heads)}
    entries = [{"placeholder": name[s["text"]], "original": s["text"], "entity_type": s["entity_type"],
                "start": s["start"], "end": s["end"]} for s in spans]
    edges = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
    between = [text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]
    return "".join(g + p for g, p in zip(between, [*[name[v] for v in values], ""], strict=True)), entries, text


def redaction_id(doc_id, text):
    return f"red_{hashlib.sha256(chr(0).join((str(doc_id), text)).encode()).hexdigest()[:8]}"


# --------------------------------------------------------------- sanitisation
#: action, pattern, flags, replacement; an action may have several rewrites
REWRITES = [
    ("stripped_control_chars", catalog.CONTROL_CHARS, 0, ""),
    ("stripped_invisible_unicode", catalog.INVISIBLE_UNICODE, 0, ""),
    ("removed_base64_blocks", catalog.BASE64_BLOCK, 0, catalog.BASE64_REPLACEMENT),
    ("removed_script_elements", catalog.HTML_SCRIPT, re.I | re.S, ""),
    ("removed_html_tags", catalog.HTML_TAG, 0, ""),
    ("removed_external_images", catalog.MD_EXTERNAL_IMAGE, 0, catalog.IMAGE_REPLACEMENT),
    ("normalized_whitespace", catalog.EXCESSIVE_BLANKS, 0, "\n\n\n"),
    ("normalized_whitespace", catalog.EXCESSIVE_SPACES, 0, " "),
]


def sanitize(text):
    """(text, valid, actions, error)."""
    limits = {catalog.ERROR_TOO_LARGE: len(text.encode("utf-8", "replace")) <= catalog.MAX_INPUT_BYTES,
              catalog.ERROR_TOO_MANY_LINES: len(text.split("\n")) <= catalog.MAX_LINE_COUNT}
    broken = [e for e, kept in limits.items() if not kept]
    if broken:
        return text, False, [], broken[0]
    versions = [("", text)]
    for action, rules in groupby(REWRITES, key=lambda r: r[0]):
        now = versions[-1][1]
        for _, pattern, flags, new in rules:
            now = re.sub(pattern, new, now, flags=flags)
        versions.append((action, now))
    return versions[-1][1], True, [a for (_, old), (a, new) in zip(versions, versions[1:], strict=False) if old != new], None


# -------------------------------------------------------- screening, auditing
def screen(text):
    hits = {r.label: r.weight for r in catalog.INJECTION_RULES if re.search(r.regex, text.lower(), re.I)}
    score = round(max(hits.values(), default=0.0), 2)
    return list(hits), score, max(hits.values(), default=0.0) >= catalog.INJECTION_THRESHOLD


def audit(sanitized, entries):
    left = [e["entity_type"] for e in entries if len(e["original"]) >= catalog.MIN_LEAK_CHECK_LENGTH
            and re.search(rf"\b{re.escape(e['original'])}\b", sanitized)]
    odd = [p for p in re.findall("<[^>]+>", sanitized) if not re.fullmatch(catalog.PLACEHOLDER_SHAPE, p)]
    return [f"pii_leak:{t}" for t in left] + [f"invalid_placeholder_format:{p}" for p in odd]


# -------------------------------------------------------------- rehydration
def _complaints(placeholders):
    """What is wrong with a manifest's list, in the order it is reported."""
    if type(placeholders) is not list:
        yield "manifest.placeholders must be a list"
        return
    if len(placeholders) > catalog.MAX_PLACEHOLDERS:
        yield f"manifest contains too many placeholders ({len(placeholders)})"
    for e in placeholders:
        if isinstance(e, dict):
            if not re.fullmatch(catalog.PLACEHOLDER_SHAPE, e.get("placeholder", "")):
                yield f"invalid placeholder format: {e.get('placeholder', '')!r}"
            if len(e.get("original", "")) > catalog.MAX_ORIGINAL_LENGTH:
                yield "original value exceeds maximum length"


def rehydrate(text, placeholders):
    for complaint in _complaints(placeholders):
        raise ValueError(complaint)
    pairs = [(e.get("placeholder", ""), e.get("original", "")) for e in placeholders if isinstance(e, dict)]
    for name, value in pairs:  # one after the other: an original may hold a later placeholder
        text = value.join(text.split(name))
    return text


# --------------------------------------------------------------- admission
def token_bucket(events, rpm, burst, stale=catalog.BUCKET_STALE_SECONDS):
    """events: [(key, ts_seconds, id)] -> {id: (allowed, retry_after)}: a bucket
    starts full, gains rpm/60 a second up to burst, an admitted request takes one."""
    out = {}
    per_second = rpm / 60.0
    for _, visits in groupby(sorted(events), key=lambda e: e[0]):
        level, since = None, None
        for _, now, event in visits:
            idle = None if since is None else now - since
            level = float(burst) if idle is None or idle > stale else min(burst, level + idle * per_second)
            since = now
            ok = level >= 1.0
            out[event] = (ok, 0.0 if ok else round((1.0 - level) / per_second, 1))
            level -= ok
    return out
