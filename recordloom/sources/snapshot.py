"""CSV snapshots: header resolution, ragged records, record numbers, the Parquet copy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.schema import resolve_header
from recordloom.sources.contracts import ContractError
from recordloom.sources.records import read_records

ROW = "row_number"
FILE = "source_file"
FIRST_RECORD = 2
_CORRUPT = "_corrupt_record"
_SENTINEL = "\x02end\x02"


def _options(multi_line: bool) -> dict[str, str]:
    return {"escape": '"', "multiLine": str(multi_line).lower(), "encoding": "UTF-8"}


def read_header(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> list[str]:
    """The first record of the first file. Empty and repeated cells are refused."""
    first = spark.read.options(**_options(multi_line)).csv(path).first()
    if first is None:
        raise ContractError("missing CSV header")
    header = ["" if cell is None else cell for cell in first]
    if header:
        header[0] = header[0].removeprefix("﻿")
    if len(header) != len(set(header)) or "" in header:
        raise ContractError("CSV header has empty or repeated cells")
    return header


def _raw(spark: SparkSession, path: str | Sequence[str], header: list[str], multi_line: bool) -> DataFrame:
    """The cells of every data record, its file, its number and, where its length is not the header's, its text."""
    records = read_records(spark, path, multi_line)
    cells = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{name} string" for name in [*cells, _CORRUPT])
    # With pruned columns the parser would not notice records of another length.
    options = {**_options(multi_line), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "columnPruning": "false"}
    parsed = records.select(F.col("file").alias(FILE), F.col("number").alias(ROW), F.from_csv("record", schema, options).alias("_cells"))
    # The header of every file must equal the first one's; a reordered file fails the scan.
    names = F.array(*[F.col("_cells")[cell] for cell in cells])
    same = names.eqNullSafe(F.array(*map(F.lit, header))) & F.col("_cells")[_CORRUPT].isNull()
    message = F.concat(F.lit("another CSV header than the first file's: "), FILE)
    data = F.when(F.col(ROW) >= FIRST_RECORD, F.lit(True)).when(same, F.lit(False)).otherwise(F.raise_error(message).cast("boolean"))
    named = [F.col("_cells")[cell].alias(name) for cell, name in zip(cells, header)]
    return parsed.where(data).select(*named, F.col("_cells")[_CORRUPT].alias(_CORRUPT), FILE, ROW)


def _q(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def scan_snapshot(
    spark: SparkSession,
    path: str | Sequence[str],
    column_map: Mapping[str, str] | None = None,
    multi_line: bool = True,
    positions: bool = False,
) -> DataFrame:
    """Every cell as text under its API field name.

    Empty cells are ``''``; a cell a short record does not have is null; cells past the header are
    left out (``ragged_records`` reports both). With ``positions`` each record comes with its file and its ``row_number``
    there: data record *n* is *n + 1*, counting records, not lines. Large files are read by many tasks, quoted line breaks or not;
    ``multi_line=False`` takes every line for a record.
    """
    header = read_header(spark, path, multi_line)
    resolved = resolve_header(header, column_map)
    raw = _raw(spark, path, header, multi_line)
    # Only the cells a short record lacks stay null: its sentinel lands in one of them.
    raw = raw.withColumn("_cells", F.when(F.col(_CORRUPT).isNotNull(), _reparsed(len(header))))
    cells = [F.col(f"_cells.c{i}") for i in range(len(header))]
    filled = F.when(
        F.col("_cells").isNotNull(),
        F.array_position(F.array(*[F.coalesce(c, F.lit("")) for c in cells]), _SENTINEL) - 1,
    )
    raw = raw.withColumn("_filled", F.when(filled >= 0, filled))
    columns = []
    for i, (name, field) in enumerate(resolved.items()):
        present = F.coalesce(F.col("_filled") > i, F.lit(True))
        columns.append(F.when(present, F.coalesce(_q(name), F.lit(""))).alias(field))
    return raw.select(*columns, *([FILE, ROW] if positions else []))


def land_snapshot(
    spark: SparkSession,
    path: str | Sequence[str],
    out: str,
    column_map: Mapping[str, str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Parse the CSV once and keep a Parquet copy with record numbers, the input of all later work.

    The numbers come with the records, so the copy is the only thing that is written.
    """
    with_row_number(spark, path, column_map, multi_line).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def with_row_number(
    spark: SparkSession,
    path: str | Sequence[str],
    column_map: Mapping[str, str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    return scan_snapshot(spark, path, column_map, multi_line, positions=True)


def ragged_records(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """(source_file, row_number, kind): every record with cells beyond the header (long) or fewer than it (short)."""
    header = read_header(spark, path, multi_line)
    suspect = _raw(spark, path, header, multi_line).where(F.col(_CORRUPT).isNotNull())
    values = F.array(*[F.col(f"cells.c{i}") for i in range(len(header))])
    short = F.coalesce(F.array_contains(F.array_compact(values), _SENTINEL), F.lit(False))
    parsed = suspect.select(FILE, ROW, _reparsed(len(header)).alias("cells"))
    return parsed.select(FILE, ROW, F.when(short, "short").otherwise("long").alias("kind"))


def _reparsed(width: int) -> Column:
    """The cells of a record of unusual length. A short one's last cell is followed by the sentinel."""
    return F.from_csv(
        F.concat(F.col(_CORRUPT), F.lit("," + _SENTINEL)), ", ".join(f"c{i} string" for i in range(width)), _options(True)
    )
