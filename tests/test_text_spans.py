"""Personal data: one resolver of spans behind counts, policies and redaction."""

import re

import pytest
from pyspark.sql import functions as F

TEXTS = {
    "ada.lovelace@example.com": ("EMAIL", "Contact Ada at {} for details."),
    "https://example.com/docs": ("URL", "Visit {} for more info."),
    "123-45-6789": ("SSN", "SSN on file: {} for verification."),
    "4111-1111-1111-1111": ("CARD", "Card number {} was charged."),
    "192.168.1.42": ("IP", "Server responded from {} during the outage."),
    "(555) 123-4567": ("PHONE", "Call us at {} during business hours."),
    "+1 555 123 4567": ("PHONE", "Or at {}."),
    "+15551234567": ("PHONE", "Or at {}."),
    "1765 Sheridan Drive": ("STREET", "Please mail the form to {} by Friday."),
    "1765 NORTH SHERIDAN DRIVE": ("STREET", "TO {} "),
    "GB29NWBK60161331926819": ("IBAN", "Pay to {} today."),
    "021000021": ("ROUTING", "Routing number {} please."),
}


def test_exact_offsets(spark):
    from lookalike.operators.text import detect_pii

    rows = [(i, said.format(hit)) for i, (hit, (_, said)) in enumerate(TEXTS.items())]
    df = spark.createDataFrame([*rows, (99, None)], "k long, body string")
    got = {r.k: r for r in detect_pii(df, "body", "k").collect()}
    for (k, body), (hit, (kind, _)) in zip(rows, TEXTS.items(), strict=True):
        assert (got[k].kind, body[got[k].start : got[k].end]) == (kind, hit)
    assert got[3].passed is True and got[3].confidence == 0.99 and got[0].passed is None
    assert len(got) == len(rows)


@pytest.mark.parametrize("said", ["reference 123456789", "1234567890123", "zip 12345-6789", "order 000000001 of 999999999"])
def test_other_numbers_stay(spark, said):
    """A number of nine digits is a routing number only if its check digits are right."""
    from lookalike.operators.text import detect_pii, redact

    df = spark.createDataFrame([(1, said)], "k long, body string")
    assert [r.kind for r in detect_pii(df, "body", "k").collect()] == []
    assert df.select(redact(F.col("body")).alias("r")).first().r == said


def test_redaction_is_the_findings(spark, sf):
    """Cutting the findings of I-01 out of a text gives what I-04 gives."""
    from lookalike.operators.text import SAID, detect_pii, pii_counts, redact

    extra = " ".join(said.format(hit) for hit, (_, said) in TEXTS.items()) + " no 123456789, My name is Ada Lovelace, card ending in 4242"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(extra))).otherwise(F.col("text")).alias("text"))
    bodies = {r.doc_id: r.text for r in docs.collect()}
    spans: dict = {}
    for r in detect_pii(docs, "text", "doc_id").collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.kind))
    for r in docs.select("doc_id", redact(F.col("text")).alias("r")).collect():
        body, found = bodies[r.doc_id], sorted(spans.get(r.doc_id, []))
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))  # no overlaps
        for start, end, kind in reversed(found):
            body = f"{body[:start]}[REDACTED_{kind}]{body[end:]}"
        for kind, pattern in SAID:
            body = re.sub(pattern, rf"\1 [REDACTED_{kind}]", body)
        assert r.r == body
    counts = {r.doc_id: sum(r[c] for c in r.asDict() if c != "doc_id") for r in pii_counts(docs, "text", "doc_id").collect()}
    assert counts == {k: len(spans.get(k, [])) for k in bodies}


def test_shapes(spark):
    """Social security and account numbers count by their digits; lengths at both ends."""
    from lookalike.functions.checks import shaped

    cases = {
        "ssn": {"123-45-6789": 1, "123456789": 1, "123 45 6789": 1, "000-12-3456": 0, "666-12-3456": 0, "900-12-3456": 0, "123-00-6789": 0, "123-45-0000": 0, "12-345-678": 0},
        "account_number": {"123456": 1, "12345": 0, "1" * 18: 1, "1" * 19: 0, "12-34 56": 1},
        "iban": {"GB29" + "A" * 10: 1, "GB29" + "A" * 9: 0, "GB29" + "A" * 30: 1, "GB29" + "A" * 31: 0},
    }
    for kind, values in cases.items():
        rows = spark.createDataFrame(list(values.items()), "v string, ok int").select("v", "ok", shaped(F.col("v"), kind).alias("s")).collect()
        assert [(r.v, bool(r.ok)) for r in rows] == [(r.v, r.s) for r in rows]
