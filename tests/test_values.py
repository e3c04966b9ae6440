import pytest

from clauselake.operators import extract, values

CASES = [
    ("liability", "cap_type", "Liability shall not exceed three (3) times the fees. More.", "multiple_of_fees"),
    ("liability", "cap_type", "Insurance is limited to $5,000,000. Its liability is limited to fees paid in the last year.", "fees_paid_period"),
    ("liability", "cap_type", "Insurance coverage for liability is limited to $5,000,000.", None),
    ("liability", "cap_type", "Liability is limited to direct loss.", "other"),
    ("termination", "cure_days", "A breach must be cured within thirty days after notice.", "30"),
    ("termination", "cure_days", "It has forty-five (45) days to cure.", "45"),
    ("termination", "notice_days", "Either party may terminate upon sixty (60) days' prior written notice.", "60"),
    ("termination", "notice_days", "It must cure within 30 days after notice.", None),
    ("termination", "convenience_termination_who", "Customer may, at any time, terminate this.", "customer_only"),
    ("termination", "convenience_termination_who", "Customer may terminate for breach.", None),
    ("payment", "payment_days", "Fees are due upon receipt.", "0"),
    ("payment", "payment_days", "Terms are net-30.", "30"),
    ("payment", "late_fee_type", "Overdue sums bear interest of 2%.", "interest_rate"),
    ("payment", "late_fee_type", "A late fee of 5% applies.", "percentage"),
    ("confidentiality", "duration_years", "The obligations survive for ninety-nine years.", "99"),
    ("confidentiality", "duration_years", "The obligations are perpetual, not five years.", None),
    ("ip", "assignment_direction", "Consultant hereby irrevocably assigns all rights.", "provider_to_customer"),
    ("ip", "assignment_direction", "Vendor may not assign this Agreement.", None),
    ("ip", "license_scope", "Vendor grants a non-exclusive license.", "non_exclusive"),
    ("ip", "license_scope", "Vendor grants the sole license.", "exclusive"),
    ("governing_law", "governing_law_jurisdiction", "Governed by the laws of the State of New York, without regard to conflicts.", "New York"),
    ("governing_law", "governing_law_jurisdiction", "Governed by the laws of another place.", None),
    ("governing_law", "arbitration_body", "Mediation under JAMS rules.", None),
    ("governing_law", "arbitration_body", "Arbitration before JAMS.", "JAMS"),
    ("governing_law", "venue_exclusivity", "The courts of Ohio have non-exclusive jurisdiction.", "non_exclusive"),
]


def test_values_and_places(spark):
    df = spark.createDataFrame([(k, t, c, "x") for k, (t, _, c, _) in enumerate(CASES)], "k long, clause_type string, clause string, value_of string")
    got = {(r["k"], r["field"]): r for r in values.extract_values(df).collect()}
    for k, (_, field, clause, want) in enumerate(CASES):
        r = got[k, field]
        assert r["value"] == want, (clause, r)
        if want is None:
            assert r["start"] is None and r["quote"] is None
        else:
            assert r["quote"] in clause and 0 <= r["start"] < r["end"] <= len(clause)
            if field == "governing_law_jurisdiction":
                assert clause[r["start"] : r["end"]].endswith(want)


def test_nulls_and_unknown_types(spark):
    df = spark.createDataFrame([("payment", None), ("payment", ""), (None, "net 30"), ("other", "net 30")], "clause_type string, clause string")
    rows = values.extract_values(df).collect()
    assert len(rows) == 6 and all(r["value"] is None for r in rows)
    assert values.extract_values(df.where("false")).count() == 0


@pytest.mark.parametrize("word,number", [("one", 1), ("nineteen", 19), ("twenty", 20), ("ninety-nine", 99)])
def test_number_words(word, number):
    assert values.NUMBERS[word] == number and len(values.NUMBERS) == 99


def test_guards_of_boolean_fields(spark):
    df = spark.createDataFrame([("liability", "Liability insurance shall not exceed $5."), ("liability", "Liability shall not exceed $5."), ("payment", "Invoice disputes go to arbitration.")], "clause_type string, clause string")
    got = {(r["clause"], r["field"]): r["value"] for r in extract.all_fields(df).collect()}
    assert not got["Liability insurance shall not exceed $5.", "has_cap"] and got["Liability shall not exceed $5.", "has_cap"]
    assert not got["Invoice disputes go to arbitration.", "has_dispute_process"]
    one = extract.extract_fields(df.where("clause_type = 'liability'"), "liability").where("has_cap").collect()
    assert [r["has_cap_source_text"] for r in one] == ["Liability shall not exceed $5."]
