"""Per-pattern cases: (text, type, expected values of that type), one DataFrame."""

import model
from pyspark.sql import functions as F

from veilspark import catalog
from veilspark.functions import spans as S

CASES = [
    ("token eyJhbGciOi.eyJzdWIi.sig_-1", "JWT", ["eyJhbGciOi.eyJzdWIi.sig_-1"]),
    ("eyJonly.part", "JWT", []),
    ("postgres://bob:pw@db:5432/x next", "DB_URL", ["postgres://bob:pw@db:5432/x"]),
    ("mysql://nopassword@host", "DB_URL", []),
    ("Bearer abcdefghijklmnopqrstu", "BEARER_TOKEN", ["abcdefghijklmnopqrstu"]),
    ("bearer abcdefghijklmnopqrstu", "BEARER_TOKEN", []),
    ("Bearer short", "BEARER_TOKEN", []),
    ('"api_key": "abcdef123456"', "API_KEY", ["abcdef123456"]),
    ("APIKEY=ABCDEFGHIJ", "API_KEY", ["ABCDEFGHIJ"]),
    ("api-key: short", "API_KEY", []),
    ("password: hunter2", "PASSWORD", ["hunter2"]),
    ("PASSWD=ab", "PASSWORD", []),
    ("client_secret=abc+/=12345", "SECRET_VALUE", ["abc+/=12345"]),
    ("credential: 0123456789", "SECRET_VALUE", ["0123456789"]),
    ("access_token=abcdefghijklmnopqrstuvwx", "AUTH_TOKEN", ["abcdefghijklmnopqrstuvwx"]),
    ("csrf_token: tooshort", "AUTH_TOKEN", []),
    ("magic_link: https://a.example/m?t=1234567", "MAGIC_LINK", ["https://a.example/m?t=1234567"]),
    ("0x" + "ab" * 32, "CRYPTO_PRIVATE_KEY", ["0x" + "ab" * 32]),
    ("0x" + "ab" * 20, "CRYPTO_ADDRESS", ["0x" + "ab" * 20]),
    ("0x" + "ab" * 21, "CRYPTO_ADDRESS", []),
    ('recovery words: "alpha beta"', "CRYPTO_SEED", ["alpha beta"]),
    ("mnemonic 'one two three'", "CRYPTO_SEED", ["one two three"]),
    ("seed phrase: unquoted words", "CRYPTO_SEED", []),
    ("card 4111 1111 1111 1111.", "CREDIT_CARD", ["4111 1111 1111 1111"]),
    ("4111-1111-1111-11112", "CREDIT_CARD", []),
    ("ssn 123-45-6789 and 987654321", "US_SSN", ["123-45-6789", "987654321"]),
    ("1234-56-789", "US_SSN", []),
    ("write to a.b+c@mail.example.org now", "EMAIL", ["a.b+c@mail.example.org"]),
    ("not@an", "EMAIL", []),
    ("DOB: 1980-02-29", "DATE_OF_BIRTH", ["1980-02-29"]),
    ("born 3/4/85", "DATE_OF_BIRTH", ["3/4/85"]),
    ("date of birth 12-31-1999", "DATE_OF_BIRTH", ["12-31-1999"]),
    ("EIN 12-3456789", "EIN", ["12-3456789"]),
    ("123456789", "EIN", []),
    ("+1 (555) 123-4567", "US_PHONE", ["1 (555) 123-4567"]),
    ("555.123.4567", "US_PHONE", ["555.123.4567"]),
    ("account no. 123456", "ACCOUNT_NUMBER", ["123456"]),
    ("acct#12345", "ACCOUNT_NUMBER", []),
    ("ABA: 021000021", "US_ROUTING", ["021000021"]),
    ("routing 421000021", "US_ROUTING", []),
    ("Driver's license: D1234567", "DRIVERS_LICENSE", ["D1234567"]),
    ("DL A12345678901234", "DRIVERS_LICENSE", ["A12345678901234"]),
    ("12 Oak St", "STREET_ADDRESS", ["12 Oak St"]),
    ("1600 Pennsylvania Ave NW Suite 200", "STREET_ADDRESS", ["1600 Pennsylvania Ave"]),
    ("77 Harbor View Ln Apt 4", "STREET_ADDRESS", ["77 Harbor View Ln Apt 4"]),
    ("NMLS ID: 123456", "NMLS_ID", ["123456"]),
    ("loan number LN-2025-0001", "LOAN_NUMBER", ["LN-2025-0001"]),
    ("MIN 100012345678901234", "MERS_MIN", ["100012345678901234"]),
    ("VA case 123-4567890-123", "FHA_CASE_NUMBER", ["123-4567890-123"]),
    ("APN: 123-456-789-0 recorded", "PARCEL_NUMBER", ["123-456-789-0"]),
    ("tax id 12.34/56 end", "PARCEL_NUMBER", ["12.34/56"]),
    ("listing id ABC1234", "MLS_NUMBER", ["ABC1234"]),
    ("escrow no. ESC-12345", "FILE_REFERENCE", ["ESC-12345"]),
    ("customer_id: 123456", "CRM_ID", ["123456"]),
    ("crm 123", "CRM_ID", []),
    ("wallet_id=0123456789abcdef0123-4567", "PLATFORM_ID", ["0123456789abcdef0123-4567"]),
    ("org id 0123456789", "PLATFORM_ID", []),
]


def test_pattern_cases(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _e, _v in CASES)), "doc_id long, text string")
    out = S.with_layer1_spans(df, "text", "sp", raw=True)
    got = {r.doc_id: r.sp for r in out.collect()}
    for i, (text, etype, values) in enumerate(CASES):
        mine = [s.text for s in got[i] if s.entity_type == etype]
        assert mine == values, (text, etype, mine)
        ref = [s["text"] for s in model.spans_layer1(text) if s["entity_type"] == etype]
        assert mine == ref, (text, etype)
        for s in got[i]:
            assert text[s.start:s.end] == s.text


def test_every_pattern_has_a_positive_case():
    covered = {e for _t, e, v in CASES if v}
    assert covered == {p.entity_type for p in catalog.LAYER1_PATTERNS}


ALLOW = [
    ("$425,000", True), ("$50k", True), ("425,000", True), ("6.75%", True), ("32% bracket", True),
    ("250 bps", True), ("2031", True), ("2019", False), ("Age 59.5", True), ("Form 1040", True),
    ("IRC §1015", True), ("HELOC", True), ("VOR", True), ("123-45-6789", False), ("2025\n", False),
    ("john@x.com", False), ("401k", True), ("RESPA", True),
]


def test_allow_patterns(spark):
    df = spark.createDataFrame([(v,) for v, _ in ALLOW], "v string")
    got = [r.a for r in df.select(S.allow_match(F.col("v")).alias("a")).collect()]
    assert got == [ok for _, ok in ALLOW]
    assert got == [model.allowed(v) for v, _ in ALLOW]
