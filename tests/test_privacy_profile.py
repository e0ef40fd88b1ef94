import random
from collections import Counter
from datetime import date

import pytest
from recordloom.operators import privacy, profile, schema
from recordloom.operators.checks import GateError, require_empty
from recordloom.sources import contracts as C
from recordloom.sources.contracts import ContractError, SourceContract
from recordloom.sources.inventory import INVENTORY

CONTRACTS = INVENTORY.require("contracts")


def one(spark, field, value):
    return spark.createDataFrame([(2, value)], f"row_number bigint, {field} string")


def test_public_columns_fail_closed(spark):
    contract = INVENTORY.require("campaign-contributions")
    df = spark.createDataFrame([(2, "Example LLC", "")], "row_number bigint, donor string, donor_address string")
    with pytest.raises(ContractError, match="not allowlisted: donor_address"):
        privacy.check_public(df, contract)
    safe = spark.createDataFrame(
        [(2, "Example LLC", "Entity", "100.00")],
        "row_number bigint, donor string, donor_type string, contribution_amount string",
    )
    assert privacy.check_public(safe, contract).count() == 0


def test_findings_are_redacted_and_ordered(spark):
    rows = [
        (4, "call 5125550199 or a@b.co", "x"),
        (3, "123 Main Street", "123-45-6789"),
        (2, "", "P.O. Box 12, 9 Elm St"),
    ]
    df = spark.createDataFrame(rows, "row_number bigint, doc_dscr string, rpt_dscr string")
    found = privacy.first_findings(privacy.check_public(df, CONTRACTS), 4).collect()
    assert [(r["row_number"], r["field"], r["kind"]) for r in found] == [
        (2, "rpt_dscr", "street_address"), (2, "rpt_dscr", "street_address"),
        (3, "doc_dscr", "street_address"), (3, "rpt_dscr", "ssn"),
    ]
    assert {r["preview"] for r in found} == {"[redacted]"} and {r["total_findings"] for r in found} == {6}
    with pytest.raises(ValueError):
        privacy.first_findings(privacy.check_public(df, CONTRACTS), 0)
    counts = privacy.finding_counts(privacy.check_public(df, CONTRACTS))
    street = counts.where("field = 'rpt_dscr' and kind = 'street_address'").first()
    assert (street["findings"], street["records"]) == (2, 1)


def test_identifier_columns_are_exempt(spark):
    contract = INVENTORY.require("campaign-contributions")
    assert privacy.check_public(one(spark, "transaction_id", "5125550199"), contract).count() == 0
    assert privacy.check_public(one(spark, "donor", "5125550199"), contract).count() == 1


def test_private_audit_reads_allowlisted_columns_only(spark, tmp_path):
    narrow = SourceContract("s", "d", "t", {"doc_dscr": (), "contract_contact_email_ad": ("restricted",)})
    df = spark.createDataFrame(
        [(2, "safe", "person@example.com")],
        "row_number bigint, doc_dscr string, contract_contact_email_ad string",
    )
    df.write.parquet(str(tmp_path / "t"))
    scan = privacy.audit_source(spark.read.parquet(str(tmp_path / "t")), narrow)
    assert scan.count() == 0
    assert "contract_contact_email_ad" not in scan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ContractError, match="required fields missing"):
        privacy.audit_source(df.drop("doc_dscr"), narrow)
    assert schema.public_projection(df, narrow).columns == ["doc_dscr"]


def test_redaction(spark):
    contract = SourceContract(
        "s", "d", "t",
        {"when": ("date",), "paid": ("amount",), "quantity": (), "link_to": (), "doc_id": (), "who": ("identity",),
         "note": (), "secret_city": ("restricted",)},
    )
    rows = [(n, "x", "5", "6", "u", "7", "Joe", " " if n % 2 else "123 Main Street", "Austin") for n in range(2, 40)]
    df = spark.createDataFrame(
        rows, "row_number bigint, when string, paid string, quantity string, link_to string, doc_id string, "
        "who string, note string, secret_city string",
    )
    fixture = privacy.checked_fixture(df, contract, 30).orderBy("row_number").collect()
    assert len(fixture) == 30 and "secret_city" not in fixture[0].asDict()
    assert tuple(fixture[0])[1:] == (
        "2000-01-01T00:00:00.000", "1.00", "1.00", "https://example.invalid/source-record/1", "SYNTHETIC-0001",
        "EXAMPLE ORGANIZATION 0001", "SYNTHETIC NOTE 0001",
    )
    assert fixture[1]["note"] == "" and fixture[28]["when"] == "2000-01-01T00:00:00.000"
    assert privacy.redact(df, contract).count() == 38


PROFILE = SourceContract(
    "s", "d", "t",
    {"kind": ("category",), "day": ("date",), "rid": ("unique",), "free": (), "none": ("date", "category"), "gone": ()},
    expected_minimum_rows=500,
)


# Dates as they are written, and what they say.
DAYS = {
    "01/01/2026": date(2026, 1, 1), "2026-01-01": date(2026, 1, 1), "12/31/2025": date(2025, 12, 31), "12/02/0023": date(23, 12, 2),
    "11/06/2104": date(2104, 11, 6), " 1/1/1850 ": date(1850, 1, 1), "01/05/1700": date(1700, 1, 5), "1/6/1700": date(1700, 1, 6),
    "1/7/1700": date(1700, 1, 7), "1/8/1700": date(1700, 1, 8),
}


def test_profile_equals_brute_force(spark):
    rng = random.Random(3)
    days = [*DAYS, "junk", ""]
    rows = [
        (i + 2, rng.choice(["hot"] * 9 + [f"k{rng.randint(0, 60)}", " ", "hot "]), rng.choice(days), str(i // 2 or ""),
         rng.choice(["", "x"]), " ")
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "row_number bigint, kind string, day string, rid string, free string, none string")
    df = df.repartition(7)
    got = {r["field"]: r for r in profile.profile_fields(df, PROFILE, 2026).collect()}
    assert set(got) == {"kind", "day", "rid", "free", "none"}
    for i, field in enumerate(("kind", "day", "rid", "free", "none"), start=1):
        values = [r[i].strip() for r in rows]
        row, kept = got[field], [v for v in values if v]
        assert (row["rows"], row["nulls"], row["null_rate"]) == (900, 900 - len(kept), (900 - len(kept)) / 900)
        tracked = field in ("kind", "day", "rid")
        assert row["distinct"] == (len(set(kept)) if tracked else None)
        assert row["duplicates"] == (len(kept) - len(set(kept)) if field == "rid" else None)
        if field == "kind":
            assert [tuple(t) for t in row["top_values"]] == Counter(kept).most_common(25)
        if field == "day":
            dated = [(at, v) for v in kept for d, at in DAYS.items() if d.strip() == v]
            assert row["minimum"] == min(dated, key=lambda p: p[0])[1]
            assert row["maximum"] == max(dated, key=lambda p: p[0])[1]
            assert row["invalid_date_count"] == len(kept) - len(dated)
            odd = [v for at, v in dated if at.year < 1900 or at.year > 2046]
            assert row["suspicious_date_count"] == len(odd)
            assert row["suspicious_date_examples"] == sorted(list(dict.fromkeys(odd))[:5])
    empty = got["none"]
    assert (empty["top_values"], empty["minimum"], empty["invalid_date_count"]) == (None, None, 0)
    assert empty["suspicious_date_examples"] == [] and got["free"]["suspicious_date_examples"] is None
    header = profile.profile_source(df, PROFILE, "data/raw/d/x.csv", "2026-01-01T00:00:00+00:00")
    (summary,) = profile.profile_summary(header).collect()
    assert tuple(summary) == ("s", 900, True, 1)


def test_empty_table_profile(spark):
    df = spark.createDataFrame([], "row_number bigint, kind string, day string, rid string")
    got = {r["field"]: r for r in profile.profile_fields(df, PROFILE, 2026).collect()}
    assert got["rid"]["null_rate"] is None and got["rid"]["duplicates"] is None and got["rid"]["distinct"] is None


def test_schema_tables(spark):
    contract = SourceContract("s", "d", "t", {"a": ("identity",), "b": (), "c_ssn": ("restricted",), "z": ("date",)})
    fields, patterns = C.contract_fields(spark, [contract]), C.restricted_patterns(spark, [contract])
    observed = spark.createDataFrame([("s", f) for f in ("a", "b", "c_ssn", "home_ADDRESS", "other")], "source string, field string")
    got = {r["field"]: r["classification"] for r in schema.classify_columns(observed, fields, patterns).collect()}
    assert got == {"a": "PUBLIC_ALLOWLISTED", "b": "PUBLIC_ALLOWLISTED", "c_ssn": "RESTRICTED",
                   "home_ADDRESS": "RESTRICTED", "other": "INTERNAL_REVIEW"}
    assert [r["field"] for r in schema.missing_fields(fields, observed).collect()] == ["z"]
    found = {tuple(r) for r in schema.public_schema_violations(observed, fields, patterns).collect()}
    assert found == {("s", "c_ssn", "not_allowlisted"), ("s", "c_ssn", "restricted"), ("s", "home_ADDRESS", "not_allowlisted"),
                     ("s", "home_ADDRESS", "restricted"), ("s", "other", "not_allowlisted")}
    catalog = spark.createDataFrame(
        [("s", 0, "A", "a", "text", "d"), ("s", 1, "Home Address", None, "text", None)],
        "source string, position int, name string, field_name string, data_type string, description string",
    )
    entries = {r["field"]: r for r in schema.field_dictionary(catalog, fields, patterns).collect()}
    assert entries["home_address"]["classification"] == "RESTRICTED" and not entries["z"]["in_catalog"]
    clash = spark.createDataFrame([("s", "Vendor Name"), ("s", "vendor-name"), ("s", "%")], "source string, name string")
    assert {(r["field"], r["headers"]) for r in schema.name_collisions(clash).collect()} == {("vendor_name", 2), ("", 1)}


def test_require_empty_hides_values(spark):
    with pytest.raises(GateError) as error:
        require_empty(spark.createDataFrame([("secret",)], "v string"), "gate")
    assert "secret" not in str(error.value)
