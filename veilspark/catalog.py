"""Catalogues: the pattern tables every operator is driven by.

Everything in the "fixed values" blocks below must equal the behaviour the
engine is specified to reproduce (regex literals, scores, labels, weights,
word lists, limits).  They are stated verbatim, in their natural order.
Users extend or replace them by passing their own catalogue objects to the
operators (see ``SpanPattern`` / ``InjectionRule``), never by editing this
module.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SpanPattern:
    """One detection rule.

    ``regex`` is written in Python ``regex``-module syntax (the specification
    dialect).  ``group`` = 1 means the entity is the first capture group and
    the rest of the match is context; 0 means the whole match.
    """

    entity_type: str
    regex: str
    score: float
    group: int = 0


@dataclass(frozen=True)
class InjectionRule:
    regex: str
    label: str
    weight: float


# ---------------------------------------------------------------------------
# FIXED VALUES: Layer-1 span patterns (entity type, regex, score, group), in
# definition order.  Definition order is also the tie-break order of the
# overlap fold.
# ---------------------------------------------------------------------------
LAYER1_PATTERNS: tuple[SpanPattern, ...] = (
    SpanPattern("JWT", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1.0),
    SpanPattern("DB_URL", r"(?:postgres|mysql|mongodb|redis)://[^:\s]+:[^@\s]+@[^\s]*", 0.95),
    SpanPattern("BEARER_TOKEN", r"Bearer\s+([A-Za-z0-9._-]{20,})", 0.90, 1),
    SpanPattern(
        "API_KEY",
        r"""(?i)["\']?(?:api[_-]?key|apikey)["\']?\s*[=:]\s*["\']?([A-Za-z0-9._-]{10,})["\']?""",
        0.85,
        1,
    ),
    SpanPattern(
        "PASSWORD",
        r"""(?i)["\']?(?:password|passwd)["\']?\s*[=:]\s*["\']?([^"\'\s,}]{3,})["\']?""",
        0.90,
        1,
    ),
    SpanPattern(
        "SECRET_VALUE",
        r"""(?i)["\']?(?:client_secret|secret_access_key|secret_key|secret|private_key|credential)["\']?\s*[=:]\s*["\']?([A-Za-z0-9._+/=-]{10,})["\']?""",
        0.85,
        1,
    ),
    SpanPattern(
        "AUTH_TOKEN",
        r"""(?i)["\']?(?:access_token|refresh_token|id_token|session_id|csrf_token)["\']?\s*[=:]\s*["\']?([A-Za-z0-9._-]{20,})["\']?""",
        0.85,
        1,
    ),
    SpanPattern(
        "MAGIC_LINK",
        r"""(?i)(?:magic[_-]?link|reset[_-]?link|verification[_-]?link)["\']?\s*[=:]\s*["\']?([^\s"\']{20,})["\']?""",
        0.85,
        1,
    ),
    SpanPattern("CRYPTO_PRIVATE_KEY", r"\b0x[a-fA-F0-9]{64}\b", 0.95),
    SpanPattern("CRYPTO_ADDRESS", r"\b0x[a-fA-F0-9]{40}\b", 0.85),
    SpanPattern(
        "CRYPTO_SEED",
        r"""(?i)(?:seed\s*phrase|mnemonic|recovery\s*(?:phrase|words?))[:\s=]*["\'](.+?)["\']""",
        0.95,
        1,
    ),
    SpanPattern("CREDIT_CARD", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", 0.95),
    SpanPattern("US_SSN", r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b", 0.90),
    SpanPattern("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95),
    SpanPattern(
        "DATE_OF_BIRTH",
        r"(?i)\b(?:DOB|born|birthday|birth.?date|date.?of.?birth)"
        r"[:\s=]*(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
        0.85,
        1,
    ),
    SpanPattern("EIN", r"\b\d{2}-\d{7}\b", 0.80),
    SpanPattern("US_PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.80),
    SpanPattern(
        "ACCOUNT_NUMBER",
        r"(?i)\b(?:(?:account|acct?)\.?\s*(?:#|no\.?|number)?:?\s*)(\d{6,17})\b",
        0.85,
        1,
    ),
    SpanPattern(
        "US_ROUTING",
        r"(?i)(?:routing|aba|transit)\s*(?:(?:#|no\.?|number)\s*)?(?::?\s*)([0-3]\d{8})\b",
        0.80,
        1,
    ),
    SpanPattern(
        "DRIVERS_LICENSE",
        r"(?i)(?:driver'?s?\s*(?:license|lic\.?)|DL)\s*(?:[#:]\s*)?([A-Za-z]\d{7,14})\b",
        0.75,
        1,
    ),
    SpanPattern(
        "STREET_ADDRESS",
        r"(?i)\b\d{1,5}\s++(?:[A-Za-z]++\s++){1,3}"
        r"(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Ln|Lane|"
        r"Rd|Road|Ct|Court|Way|Pl|Place|Cir|Circle)"
        r"\.?\b(?:\s*+(?:#|Ste|Suite|Apt|Unit)\s*+\w++)?",
        0.70,
    ),
    SpanPattern(
        "NMLS_ID",
        r"(?i)(?:NMLS|MLO)\s*(?:(?:#|no\.?|number|id)\s*)?(?:[#:=]\s*)?(\d{5,12})\b",
        0.80,
        1,
    ),
    SpanPattern(
        "LOAN_NUMBER",
        r"(?i)(?:loan|mortgage|note)\s*(?:(?:#|no\.?|number|id)\s*)?"
        r"(?:[#:=]\s*)?([A-Z0-9][-A-Z0-9]{7,19})\b",
        0.80,
        1,
    ),
    SpanPattern("MERS_MIN", r"(?i)(?:MERS|MIN)\s*(?:[#:=]\s*)?(\d{18})\b", 0.85, 1),
    SpanPattern(
        "FHA_CASE_NUMBER",
        r"(?i)(?:FHA|VA|USDA)\s*(?:case)?\s*(?:[#:=]\s*)?(\d{3}-\d{7}(?:-\d{3})?)\b",
        0.85,
        1,
    ),
    SpanPattern(
        "PARCEL_NUMBER",
        r"(?i)(?:APN|parcel|tax\s*+(?:parcel|id|lot)|property\s*+(?:index|id|PIN)"
        r"|assessor)\s*+(?:(?:#|no\.?|number)\s*+)?(?:[#:=]\s*+)?"
        r"([A-Z0-9][-A-Z0-9./]{4,24}+)\b",
        0.80,
        1,
    ),
    SpanPattern(
        "MLS_NUMBER",
        r"(?i)(?:MLS|listing)\s*(?:(?:#|no\.?|number|id)\s*)?(?:[#:=]\s*)?([A-Z0-9]{6,15})\b",
        0.75,
        1,
    ),
    SpanPattern(
        "FILE_REFERENCE",
        r"(?i)(?:escrow|title|closing|instrument|recording|document)"
        r"\s*(?:(?:#|no\.?|number)\s*)?(?:[#:=]\s*)?"
        r"([A-Z0-9][-A-Z0-9]{5,19})\b",
        0.75,
        1,
    ),
    SpanPattern(
        "CRM_ID",
        r"(?i)(?:crm|contact[_\s]?id|client[_\s]?id|customer[_\s]?id"
        r"|lead[_\s]?id|record[_\s]?id|advisor[_\s]?id)"
        r"\s*(?:[#:=]\s*)?(\d{4,10})\b",
        0.85,
        1,
    ),
    SpanPattern(
        "PLATFORM_ID",
        r"(?i)(?:org[_\s]?id|sub[_\s]?org|tenant[_\s]?id|workspace[_\s]?id"
        r"|vault[_\s]?id|signer[_\s]?id|key[_\s]?id|wallet[_\s]?id)"
        r"\s*(?:[#:=]\s*)?([a-f0-9][a-f0-9-]{19,})\b",
        0.75,
        1,
    ),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: financial recognisers (Layer 3).  Whole match is the span.
# CUSIP carries context words; the context boost amount is a parameter.
# ---------------------------------------------------------------------------
LAYER3_PATTERNS: tuple[SpanPattern, ...] = (
    SpanPattern("CUSIP", r"\b[A-Z0-9]{6}[A-Z0-9]{2}[0-9]\b", 0.6),
    SpanPattern("ACCOUNT_REF", r"(?i)(?:account|acct)\s+ending\s+in\s+(\d{4,})", 0.8),
    SpanPattern("ACCOUNT_REF", r"(?i)(?:account|acct)[\s#]*(\d{4,})", 0.6),
    SpanPattern("POLICY_NUMBER", r"(?i)(?:policy|plan|contract)[\s#:]*([A-Z0-9]{6,20})", 0.6),
)
CUSIP_CONTEXT_WORDS: tuple[str, ...] = ("cusip", "security", "holding", "fund", "isin")

# FIXED VALUES: recogniser type names -> canonical names.
TYPE_MAP: dict[str, str] = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "US_PHONE"}

# FIXED VALUES: entity types requested from Layers 2/3 per document context.
CONTEXT_ENTITIES: dict[str, tuple[str, ...]] = {
    "meeting_transcript": (
        "PERSON", "LOCATION", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD",
        "NRP", "ACCOUNT_REF", "POLICY_NUMBER",
    ),
    "tax_return": (
        "PERSON", "LOCATION", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD",
        "ACCOUNT_REF",
    ),
    "financial_notes": (
        "PERSON", "LOCATION", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD",
        "CUSIP", "ACCOUNT_REF", "POLICY_NUMBER",
    ),
    "general": ("PERSON", "LOCATION", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD"),
    "mortgage": (
        "PERSON", "LOCATION", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD",
        "NRP", "ACCOUNT_REF", "POLICY_NUMBER",
    ),
    "real_estate": (
        "PERSON", "LOCATION", "PHONE_NUMBER", "EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD",
        "ACCOUNT_REF", "POLICY_NUMBER",
    ),
}
DEFAULT_CONTEXT = "general"

# ---------------------------------------------------------------------------
# FIXED VALUES: allow-list patterns (Layer 4), matched against the whole span
# text; one alternative per entry.
# ---------------------------------------------------------------------------
ALLOW_PATTERNS: tuple[str, ...] = (
    r"\$[\d,]+(?:\.\d{1,2})?(?:[kKmMbB])?",
    r"\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?",
    r"\d+\.?\d*\s*%",
    r"(?:10|12|22|24|32|35|37)\s*%\s*(?:bracket|rate|tier)",
    r"\d+\s*(?:bps?|basis\s+points?)",
    r"20[2-9]\d",
    r"(?i)age\s+\d{1,3}(?:\.\d)?",
    r"(?:Form|Schedule|IRC\s*§?)\s*[A-Z0-9§.-]+",
    r"(?:AGI|MAGI|QBI|RMD|QCD|NUA|IRA|SEP|SIMPLE|401k|403b|457b|529|HSA|FSA|W2|W-2|1099)",
    r"(?:LTV|DTI|PMI|PITI|MIP|UFMIP|ARM|FRM|HELOC|HEL)",
    r"(?:TILA|RESPA|ECOA|HMDA|TRID|URLA|QM|ATR)",
    r"(?:DU|LP|AUS|GFE|LE|CD|HUD)",
    r"(?:ALTA|CLTA|CPL|FNMA|FHLMC|GNMA)",
    r"(?:VOE|VOD|VOM|VOR)",
)

# FIXED VALUES: literal allow terms, excluded from Layer 2/3 detections only.
ALLOW_TERMS: tuple[str, ...] = (
    "AGI", "MAGI", "QBI", "RMD", "QCD", "NUA", "IRA", "SEP", "SIMPLE", "HSA", "FSA",
    "Roth", "FICO", "CUSIP", "ISIN", "ETF", "NAV", "AUM", "EBITDA", "P/E", "EPS", "ROI",
    "ROE", "CROIC", "W2", "W-2", "1099",
    "LTV", "DTI", "PMI", "PITI", "MIP", "ARM", "FRM", "HELOC", "TILA", "RESPA", "ECOA",
    "HMDA", "TRID", "URLA", "ALTA", "CLTA", "FNMA", "FHLMC", "GNMA", "FHA", "HUD", "VOE",
    "VOD", "VOM", "QM", "ATR", "DU", "LP", "AUS", "GFE", "APR", "MERS", "MLS", "HOA",
    "Fannie Mae", "Freddie Mac", "Ginnie Mae",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt-injection rules (regex, label, weight), in order.  All
# are case-insensitive and are searched in the lower-cased text.
# ---------------------------------------------------------------------------
INJECTION_RULES: tuple[InjectionRule, ...] = (
    InjectionRule(
        r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+instructions?",
        "ignore_previous_instructions",
        0.95,
    ),
    InjectionRule(r"ignore\s+your\s+instructions?", "ignore_your_instructions", 0.95),
    InjectionRule(
        r"disregard\s+(?:all\s+)?(?:previous|prior|above|your)\s+(?:instructions?|rules?|guidelines?)",
        "disregard_instructions",
        0.90,
    ),
    InjectionRule(
        r"(?:forget|drop|dismiss)\s+(?:all\s+)?(?:previous|prior|your)\s+(?:instructions?|context|rules?)",
        "forget_instructions",
        0.90,
    ),
    InjectionRule(
        r"do\s+not\s+follow\s+(?:any\s+)?(?:previous|prior|your)\s+(?:instructions?|rules?)",
        "do_not_follow",
        0.90,
    ),
    InjectionRule(r"(?:act|behave|respond)\s+as\s+if\s+you", "act_as_if", 0.80),
    InjectionRule(r"(?:pretend|imagine|suppose)\s+(?:that\s+)?you\s+are", "pretend_you_are", 0.80),
    InjectionRule(r"you\s+are\s+now\s+(?:a\s+)?(?:new|different|unrestricted)", "you_are_now", 0.85),
    InjectionRule(r"\bDAN\b", "dan_jailbreak", 0.60),
    InjectionRule(r"do\s+anything\s+now", "do_anything_now", 0.85),
    InjectionRule(
        r"(?:reveal|show|display|print|output|repeat)\s+(?:your|the|my)\s+(?:system\s+)?(?:prompt|instructions?|rules?)",
        "reveal_prompt",
        0.85,
    ),
    InjectionRule(
        r"what\s+(?:are|were)\s+your\s+(?:original\s+)?(?:instructions?|rules?|guidelines?)",
        "extract_instructions",
        0.80,
    ),
    InjectionRule(
        r"(?:show|give|tell)\s+me\s+your\s+(?:system\s+)?(?:prompt|instructions?|rules?)",
        "show_me_instructions",
        0.85,
    ),
    InjectionRule(r"\b(?:system\s*prompt|override|bypass|jailbreak)\b", "injection_keyword", 0.50),
    InjectionRule(
        r"\b(?:injection|exploit|payload)\s*(?:test|attempt|attack)\b", "injection_test_keyword", 0.40
    ),
    InjectionRule(r"i\s+g\s+n\s+o\s+r\s+e", "spaced_ignore", 0.75),
    InjectionRule(r"(?:1gn0r3|ign0re|1gnore)\s+(?:previous|prior|your|all)", "leetspeak_ignore", 0.80),
    InjectionRule(r"(?:s\s*y\s*s\s*t\s*e\s*m|p\s*r\s*o\s*m\s*p\s*t)", "spaced_system_prompt", 0.65),
    InjectionRule(r"new\s+(?:session|conversation|chat|context)\s*[:\-]", "new_session_marker", 0.70),
    InjectionRule(r"(?:###|===)\s*(?:system|instruction|new\s+prompt)", "fake_system_delimiter", 0.85),
    InjectionRule(r"\[(?:system|instruction|INST)\]", "fake_system_tag", 0.80),
    InjectionRule(r"<\|(?:im_start|im_end|system|endoftext)\|>", "fake_special_token", 0.90),
    InjectionRule(r"```\s*system\b", "code_block_system", 0.70),
)
INJECTION_THRESHOLD = 0.7

# ---------------------------------------------------------------------------
# FIXED VALUES: input sanitisation limits, patterns and action labels.
# ---------------------------------------------------------------------------
MAX_INPUT_BYTES = 1_048_576
MAX_LINE_COUNT = 50_000
MAX_REQUEST_CHARS = 1_000_000
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INVISIBLE_UNICODE = (
    r"["
    r"\u00ad"
    r"\u034f"
    r"\u061c"
    r"\u115f\u1160"
    r"\u17b4\u17b5"
    r"\u180e"
    r"\u200b-\u200f"
    r"\u202a-\u202e"
    r"\u2060-\u2064"
    r"\u2066-\u2069"
    r"\u206a-\u206f"
    r"\ufeff"
    r"\ufff9-\ufffb"
    r"]+"
)
BASE64_BLOCK = r"(?<!\w)[A-Za-z0-9+/]{200,}={0,2}(?!\w)"
HTML_SCRIPT = r"<script[^>]*>.*?</script>"
HTML_TAG = r"</?[a-zA-Z][^>]*>"
MD_EXTERNAL_IMAGE = r"!\[[^\]]*\]\(https?://[^)]+\)"
EXCESSIVE_BLANKS = r"\n{4,}"
EXCESSIVE_SPACES = r"[^\S\n]{10,}"
BASE64_REPLACEMENT = "[BASE64_REMOVED]"
IMAGE_REPLACEMENT = "[IMAGE_REMOVED]"
ERROR_TOO_LARGE = "Input is too large"
ERROR_TOO_MANY_LINES = "Input has too many lines"
ACTION_LABELS = (
    "stripped_control_chars",
    "stripped_invisible_unicode",
    "removed_base64_blocks",
    "removed_script_elements",
    "removed_html_tags",
    "removed_external_images",
    "normalized_whitespace",
)

# FIXED VALUES: placeholder shape, manifest version and rehydration limits.
PLACEHOLDER_SHAPE = r"<[A-Z][A-Z_]*_\d+>"
MANIFEST_VERSION = "1.0"
MAX_PLACEHOLDERS = 10_000
MAX_ORIGINAL_LENGTH = 1_000
MIN_LEAK_CHECK_LENGTH = 5

# FIXED VALUES: token-bucket admission defaults and key eviction.
DEFAULT_RPM = 60
DEFAULT_BURST = 10
BUCKET_STALE_SECONDS = 1800.0
