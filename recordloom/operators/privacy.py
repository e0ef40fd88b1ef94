"""Scans for personal data and value-free fixtures. Findings say where and what kind, never what."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.pii import REDACTED, has_digit, pattern_hits
from recordloom.functions.text import strip
from recordloom.operators.checks import require_empty
from recordloom.operators.schema import check_public_columns
from recordloom.sources.contracts import SourceContract
from recordloom.session import ship_package
from recordloom.sources.snapshot import ROW

FINDING = ("row_number", "field", "kind", "preview")
_FOUND = "struct<field: string, kind: string, field_position: int, pattern_position: int>"
_FINDING_ORDER = ("row_number", "field_position", "pattern_position")

# The texts a redacted fixture is filled with.
FIXTURE_DATE = "2000-01-%02dT00:00:00.000"
FIXTURE_URL = "https://example.invalid/source-record/%d"
FIXTURE_ID = "SYNTHETIC-%04d"
FIXTURE_NAME = "EXAMPLE ORGANIZATION %04d"
FIXTURE_TEXT = "SYNTHETIC %s %%04d"


def _found(df: DataFrame, fields: Sequence[str], row: str) -> DataFrame:
    """(row_number, found): the findings of each record in one array, in column and pattern order."""
    flags: list[Column] = []
    for position, field in enumerate(fields):
        value, numbered = F.col(field), []
        for pattern, kind, hit in pattern_hits(value, field):
            finding = F.struct(
                F.lit(field).alias("field"),
                F.lit(kind).alias("kind"),
                F.lit(position).alias("field_position"),
                F.lit(pattern).alias("pattern_position"),
            )
            if kind == "email":
                flags.append(F.array(F.when(hit, finding)))
            else:
                numbered.append(F.when(hit, finding))
        flags.append(F.coalesce(F.when(has_digit(value), F.array(*numbered)), F.array(F.lit(None).cast(_FOUND))))
    return df.select(F.col(row).alias(ROW), F.array_compact(F.concat(*flags)).alias("found"))


def pii_scan(df: DataFrame, fields: Sequence[str], row: str = ROW) -> DataFrame:
    """Every finding over whole cells: at most one per cell and pattern, no cap.

    One narrow pass: the patterns of all fields fill one array per record and only records with
    findings produce rows, so nothing is shuffled.
    """
    found = _found(df, fields, row).select(ROW, F.explode("found").alias("f"))
    return found.select(
        ROW, "f.field", "f.kind", F.lit(REDACTED).alias("preview"), "f.field_position", "f.pattern_position"
    )


_FIRST_SCHEMA = "row_number bigint, field string, kind string, preview string, field_position int, pattern_position int, total_findings bigint"


def _first_of(count: int, last: bool):
    """A task's first ``count`` findings, and how many it has seen in a row of their own; at the end beside each finding.

    The result of a task has the form of its input, so it can be cut again with those of others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            seen = table.column("total_findings")
            total += pc.sum(seen).as_py() or 0
            table = table.filter(pc.is_valid(table.column(ROW)))
            table = table if held is None else pa.concat_tables([held, table])
            order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in _FINDING_ORDER])
            held = table.take(order.slice(0, count)).combine_chunks()
        if held is None:
            return
        at = held.schema.get_field_index("total_findings")
        if last:
            held = held.set_column(at, held.schema.field(at), pa.array([total] * len(held), pa.int64()))
        else:
            # Findings that go on were counted here.
            held = held.set_column(at, held.schema.field(at), pa.array([0] * len(held), pa.int64()))
            counts = pa.table({f.name: pa.array([total if f.name == "total_findings" else None], f.type) for f in held.schema}, schema=held.schema)
            held = pa.concat_tables([held, counts])
        yield from held.combine_chunks().to_batches()

    return run


#: Tasks whose first findings are cut together before the last cut.
_CUTS = 64


def first_findings(findings: DataFrame, count: int = 25) -> DataFrame:
    """The first ``count`` findings in record, column and pattern order, and the exact total.

    One pass: every task keeps its first findings and counts all, and what the tasks return is cut twice more. Findings
    are neither written out nor sent anywhere but for the first of each task.
    """
    if count < 1:
        raise ValueError("count must be positive")
    ship_package(findings.sparkSession)
    kept = findings.select(F.col(ROW).cast("bigint").alias(ROW), *FINDING[1:], "field_position", "pattern_position", F.lit(1).cast("bigint").alias("total_findings"))
    for tasks in (None, _CUTS, 1):
        kept = (kept if tasks is None else kept.repartition(tasks)).mapInArrow(_first_of(count, tasks == 1), _FIRST_SCHEMA)
    return kept.orderBy(*_FINDING_ORDER).select(*FINDING, "total_findings")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings and distinct records per field and kind, of findings that are already there. See ``scan_counts``."""
    per_record = findings.groupBy("field", "kind", ROW).agg(F.count("*").alias("n"))
    return per_record.groupBy("field", "kind").agg(
        F.sum("n").alias("findings"), F.count("*").alias("records")
    )


def scan_counts(df: DataFrame, fields: Sequence[str], row: str = ROW) -> DataFrame:
    """(field, kind, findings, records) of a table, in one pass: a record's findings are still together when they are counted.

    Only one row for each field, kind and task is sent on. Records count one by one, whatever their numbers.
    """
    kinds = F.transform("found", lambda f: F.struct(f["field"].alias("field"), f["kind"].alias("kind")))
    each = F.transform(
        F.array_distinct(kinds), lambda k: F.struct(k["field"].alias("field"), k["kind"].alias("kind"), F.size(F.filter(kinds, lambda other: other == k)).alias("n"))
    )
    counted = _found(df, fields, row).select(F.explode(each).alias("c"))
    return counted.groupBy("c.field", "c.kind").agg(F.sum("c.n").cast("bigint").alias("findings"), F.count("*").alias("records"))


def check_public(df: DataFrame, contract: SourceContract, row: str = ROW) -> DataFrame:
    """Findings of a table meant for publication, in its own column order.

    Its columns must all be allowlisted; anything else is refused before a value is read.
    """
    columns = [c for c in df.columns if c != row]
    check_public_columns(columns, contract)
    return pii_scan(df, columns, row)


def audit_source(df: DataFrame, contract: SourceContract, row: str = ROW) -> DataFrame:
    """Findings in the allowlisted columns of a private snapshot; other columns are never read."""
    contract.require_fields(df.columns, contract.public_fields)
    return pii_scan(df.select(row, *contract.public_fields), contract.public_fields, row)


def audit_counts(df: DataFrame, contract: SourceContract) -> DataFrame:
    """``scan_counts`` of the allowlisted columns of a private snapshot."""
    contract.require_fields(df.columns, contract.public_fields)
    return scan_counts(df, contract.public_fields)


def _fixture_value(field: str, number: Column, contract: SourceContract) -> Column:
    """The stand-in for a non-blank value of ``field`` in the n-th record."""
    if field in contract.fields("date"):
        return F.format_string(FIXTURE_DATE, (number - 1) % 28 + 1)
    if field in contract.fields("amount") or field == "quantity":
        return F.format_string("%d.00", number)
    if "url" in field or field.startswith(("link_", "view_")):
        return F.format_string(FIXTURE_URL, number)
    if field.endswith(("_id", "_number", "_code")):
        return F.format_string(FIXTURE_ID, number)
    if field in contract.fields("identity") or field == contract.name_field:
        return F.format_string(FIXTURE_NAME, number)
    return F.format_string(FIXTURE_TEXT % field.upper(), number)


def redact(df: DataFrame, contract: SourceContract, rows: int | None = None, row: str = ROW) -> DataFrame:
    """Public columns with every non-blank value replaced; blanks keep the null shape.

    ``rows`` keeps the first records only, as a small fixture; None masks the whole table.
    """
    first = df if rows is None else df.where(F.col(row) <= rows + 1)
    number = F.col(row) - 1
    fields = [f for f in contract.public_fields if f in df.columns]
    masked = [
        F.when(strip(F.coalesce(F.col(f), F.lit(""))) == "", "")
        .otherwise(_fixture_value(f, number, contract)).alias(f)
        for f in fields
    ]
    return first.select(row, *masked)


def checked_fixture(df: DataFrame, contract: SourceContract, rows: int = 20, row: str = ROW) -> DataFrame:
    """A redacted fixture that has itself passed the scan."""
    fixture = redact(df, contract, rows, row)
    require_empty(check_public(fixture, contract, row), f"{contract.slug}: fixture failed its scan")
    return fixture

