"""Gates over the columns of many tables at once."""

from recordloom.operators import schema
from recordloom.plans import review
from recordloom.plans.candidates import EVIDENCE


def test_header_rules(spark):
    rows = [
        ("good", ["Id", "Näme (full)", "x"]), ("empty", ["Id", "", None]), ("twice", ["Id", "a", "Id"]), ("signs", ["Id", "--", "?!"]),
        ("alike", ["Name full", "name_full"]), ("all", ["", "a", "a", "!", "B c", "b-C"]), ("none", []), ("null", None),
    ]
    found = {}
    for r in schema.header_violations(spark.createDataFrame(rows, "source string, header array<string>")).collect():
        found.setdefault(r["source"], set()).add(r["rule"])
    assert found == {
        "empty": {"empty_cell"}, "twice": {"repeated_cell"}, "signs": {"unusable_name"}, "alike": {"colliding_names"},
        "all": {"empty_cell", "repeated_cell", "unusable_name", "colliding_names"}, "none": {"empty_header"}, "null": {"empty_header"},
    }


def test_filters_on_public_fields_only(spark):
    fields = spark.createDataFrame([("a", "x", "public"), ("a", "y", "restricted"), ("b", "y", "public"), ("a", "x", "date")], "source string, field string, role string")
    filters = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "y"), ("c", "x")], "source string, field string")
    assert sorted(map(tuple, schema.filter_violations(filters, fields).collect())) == [("a", "y"), ("c", "x")]


def test_worksheet_columns(spark):
    expected = [*EVIDENCE, *review.REVIEW]
    sheets = {
        "good": expected, "numbered": [*expected, "row_number"], "short": expected[:-1], "swapped": [expected[1], expected[0], *expected[2:]],
        "more": ["extra", *expected], "twice": [*expected, expected[3]], "other": ["x"],
    }
    rows = [(name, i, column) for name, columns in sheets.items() for i, column in enumerate(columns)]
    found = {}
    for r in review.review_column_violations(spark.createDataFrame(rows, "source string, position int, column string")).collect():
        found.setdefault(r["source"], set()).add((r["column"], r["rule"]))
    assert found.pop("other") == {("x", "unexpected"), *((c, "missing") for c in expected)}
    assert found.pop("more") == {("extra", "unexpected"), *((c, "misplaced") for c in expected)}
    assert found == {
        "short": {(expected[-1], "missing")}, "twice": {(expected[3], "repeated")},
        "swapped": {(expected[0], "misplaced"), (expected[1], "misplaced")},
    }
