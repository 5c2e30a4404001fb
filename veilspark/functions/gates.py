"""Cheap pre-tests that let a row skip a regex that cannot match it.

Each entry lists literals of which *every* match of that pattern contains at
least one (derived from the pattern's mandatory alternatives).  The test is
``contains`` (a byte search, where ``instr`` walks code points) on the lower-cased text computed once per row, so
a row pays one full regex scan only for patterns whose keywords it contains.

Case-insensitive Unicode matching also equates four non-ASCII code points
with ASCII letters that ``lower`` does not map onto them (dotless i, long s,
Kelvin sign, dotted capital I); a row containing any of them is never gated.
Patterns without a keyword are gated on containing a digit where the
pattern requires one.  ``tests/test_gates.py`` checks gated == ungated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import SpanPattern
from . import dialect

# entity type -> (literals, case_sensitive)
KEYWORDS: dict[str, tuple[tuple[str, ...], bool]] = {
    "JWT": (("eyJ",), True),
    "DB_URL": (("://",), True),
    "BEARER_TOKEN": (("Bearer",), True),
    "API_KEY": (("api",), False),
    "PASSWORD": (("passw",), False),
    "SECRET_VALUE": (("secret", "private_key", "credential"), False),
    "AUTH_TOKEN": (("_token", "session_id"), False),
    "MAGIC_LINK": (("link",), False),
    "CRYPTO_PRIVATE_KEY": (("0x",), True),
    "CRYPTO_ADDRESS": (("0x",), True),
    "CRYPTO_SEED": (("seed", "mnemonic", "recovery"), False),
    "EMAIL": (("@",), True),
    "DATE_OF_BIRTH": (("dob", "born", "birth"), False),
    "ACCOUNT_NUMBER": (("acc",), False),
    "US_ROUTING": (("routing", "aba", "transit"), False),
    "DRIVERS_LICENSE": (("driver", "dl"), False),
    "NMLS_ID": (("nmls", "mlo"), False),
    "LOAN_NUMBER": (("loan", "mortgage", "note"), False),
    "MERS_MIN": (("mers", "min"), False),
    "FHA_CASE_NUMBER": (("fha", "va", "usda"), False),
    "PARCEL_NUMBER": (("apn", "parcel", "tax", "property", "assessor"), False),
    "MLS_NUMBER": (("mls", "listing"), False),
    "FILE_REFERENCE": (("escrow", "title", "closing", "instrument", "recording", "document"), False),
    "CRM_ID": (("crm", "contact", "client", "customer", "lead", "record", "advisor"), False),
    "PLATFORM_ID": (("org", "tenant", "workspace", "vault", "signer", "key", "wallet"), False),
    "ACCOUNT_REF": (("acc",), False),
    "POLICY_NUMBER": (("policy", "plan", "contract"), False),
}
# patterns that need at least one decimal digit somewhere in the match
NEEDS_DIGIT = {"CREDIT_CARD", "US_SSN", "EIN", "US_PHONE", "STREET_ADDRESS", "CUSIP"}
# keyword patterns whose value also requires a digit (\d in the value)
KEYWORD_AND_DIGIT = {"DATE_OF_BIRTH", "ACCOUNT_NUMBER", "US_ROUTING", "DRIVERS_LICENSE", "NMLS_ID",
                     "MERS_MIN", "FHA_CASE_NUMBER", "CRM_ID", "ACCOUNT_REF"}

# Keyword-led and digit-led patterns: the characters a match can start with.  Prefixed as a
# lookahead ``(?=[...])`` (same flags as the pattern, so case folding is the
# same) it lets the matcher reject most positions with one class test instead
# of trying every keyword alternative or word boundary.
FIRST_CHARS: dict[str, str] = {
    "DB_URL": "pmr",
    "API_KEY": "\"'a",
    "PASSWORD": "\"'p",
    "SECRET_VALUE": "\"'csp",
    "AUTH_TOKEN": "\"'arisc",
    "MAGIC_LINK": "mrv",
    "CRYPTO_SEED": "smr",
    "DATE_OF_BIRTH": "db",
    "ACCOUNT_NUMBER": "a",
    "US_ROUTING": "rat",
    "DRIVERS_LICENSE": "d",
    "NMLS_ID": "nm",
    "LOAN_NUMBER": "lmn",
    "MERS_MIN": "m",
    "FHA_CASE_NUMBER": "fvu",
    "PARCEL_NUMBER": "apt",
    "MLS_NUMBER": "ml",
    "FILE_REFERENCE": "etcird",
    "CRM_ID": "clra",
    "PLATFORM_ID": "ostwvk",
    "ACCOUNT_REF": "a",
    "POLICY_NUMBER": "pc",
    "CREDIT_CARD": r"\d",
    "US_SSN": r"\d",
    "EIN": r"\d",
    "US_PHONE": r"+(\d",
    "STREET_ADDRESS": r"\d",
}

FOLD_SPECIAL = "\u0131\u017f\u212a\u0130"
_ANY_DIGIT = "(?U)\\d"


def _by_body() -> dict[str, tuple | str]:
    """Gate per catalogue pattern *body* (flags stripped), so a user pattern
    that reuses a type name with a different regex is never gated."""
    out: dict[str, tuple | str] = {}
    for p in catalog.LAYER1_PATTERNS + catalog.LAYER3_PATTERNS:
        body = dialect.split_flags(p.regex)[1]
        if p.entity_type in KEYWORDS:
            lits, cs = KEYWORDS[p.entity_type]
            out[body] = (lits, cs, p.entity_type in KEYWORD_AND_DIGIT)
        elif p.entity_type in NEEDS_DIGIT:
            out[body] = "digit"
    return out


_GATES = _by_body()
_FIRST = {dialect.split_flags(p.regex)[1]: FIRST_CHARS[p.entity_type]
          for p in catalog.LAYER1_PATTERNS + catalog.LAYER3_PATTERNS if p.entity_type in FIRST_CHARS}


def lookahead(pattern: SpanPattern) -> str | None:
    """``(?=[...])`` for a catalogue keyword or digit-led pattern, else None."""
    chars = _FIRST.get(dialect.split_flags(pattern.regex)[1])
    return f"(?=[{chars}])" if chars else None


def gate(pattern: SpanPattern, text: Column, lowered: Column, special: Column, has_digit: Column) -> Column | None:
    """Column that is false only when the pattern cannot match; None = no gate."""
    flags, body = dialect.split_flags(pattern.regex)
    g = _GATES.get(body)
    if g is None:
        return None
    if g == "digit":
        return has_digit
    lits, case_sensitive, digit = g
    case_sensitive = case_sensitive and "i" not in flags
    hay = text if case_sensitive else lowered
    cond = None
    for lit in lits:
        c = hay.contains(lit if case_sensitive else lit.lower())
        cond = c if cond is None else (cond | c)
    cond = cond if case_sensitive else (cond | special)
    return (cond & has_digit) if digit else cond


def gate_inputs(text: Column) -> tuple[Column, Column, Column]:
    """(lowered text, has-special-fold-char, has-digit) for one row."""
    return F.lower(text), special_fold(text), text.rlike(_ANY_DIGIT)


def special_fold(text: Column) -> Column:
    """Whether the text holds one of the characters that are never gated."""
    return reduce(lambda a, b: a | b, [text.contains(c) for c in FOLD_SPECIAL])
