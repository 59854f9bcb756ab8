"""Evidence of column names and shapes of values."""

import pytest

NAMES = {
    "customer_id": {"identifier"}, "orderKeys": {"identifier"}, "valid": set(), "work_email": {"email"}, "emailAddress": {"email", "address"},
    "name": {"person_name"}, "first_name": {"person_name"}, "patientName": {"person_name"}, "surnames": {"person_name"}, "product_name": set(), "facility_name": set(), "file_name": set(),
    "supplier_name": {"company"}, "employer": {"company"}, "mobile_no": {"phone_number"}, "fax_numbers": {"phone_number"}, "zip_code": {"postal_code"}, "postcode": {"postal_code"},
    "home_city": {"city"}, "city_name": {"city"}, "state_code": {"state", "category"}, "country": {"country"}, "address_line": {"address"},
    "is_active": {"boolean"}, "opt_in_flag": {"boolean"}, "created_at": {"datetime"}, "order_date": {"datetime"}, "status": {"category"}, "type_codes": {"category"}, "branch": {"category"}, "notes": {"free_text"}, "history": set(),
}


def test_names(spark):
    from lookalike.operators.semantics import score_names

    got = {n: set() for n in NAMES}
    for r in score_names(spark, list(NAMES)).collect():
        got[r.column_name].add(r.semantic)
    assert got == NAMES


def test_places_are_never_modelled_by_frequency(spark):
    """A city of few values stays a city; organisations that look like people stay none."""
    from lookalike.operators.semantics import infer, score_patterns

    rows = [("Berlin" if i % 2 else "Rome", "Anna Bell" if i % 2 else "Carl Dorn", "Anna Bell", "555-123-4567" if i % 2 else "+49 30 901820", "2024-01-01") for i in range(60)]
    df = spark.createDataFrame(rows, "city string, hospital string, said string, contact_no string, day_text string")
    assert {r.column_name: r.semantic_type for r in infer(df).collect()}["city"] == "city"
    found = {(r.column_name, r.semantic) for r in score_patterns(df).collect()}
    assert ("said", "person_name") in found and ("hospital", "person_name") not in found
    assert ("contact_no", "phone_number") in found and ("day_text", "phone_number") not in found


@pytest.mark.parametrize(("said", "ok"), [("(555) 123-4567", 1), ("+1 (555) 123-4567", 1), ("+442079460958", 1), ("98765 43210", 1), ("01 23 45 67 89", 1), ("020 7946 0958", 1), ("2024-01-01", 0), ("12345678", 0), ("5551234567", 0), ("+1234567890123456", 0), ("555-1234", 0)])
def test_phones_by_digits(said, ok):
    import re

    from lookalike.operators.semantics import PATTERN_EVIDENCE

    phone = next(p for t, p, _ in PATTERN_EVIDENCE if t == "phone_number")
    assert bool(re.match(phone, said)) == bool(ok)
