"""From stored artifacts to checked tables: the newest snapshot of a source, public files, worksheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.checks import GateError, require_empty, require_rows
from recordloom.operators.privacy import audit_source, check_public
from recordloom.operators.schema import check_public_columns, column_map, column_map_dict, resolve_header
from recordloom.plans.candidates import Source
from recordloom.plans.review import check_review_columns
from recordloom.sources import manifests as M
from recordloom.sources.catalog import read_column_catalog, read_metadata
from recordloom.sources.contracts import SourceContract
from recordloom.sources.snapshot import land_snapshot, ragged_records, read_header, with_row_number


def latest_path(manifests: DataFrame, contract: SourceContract, operation: str) -> str:
    """Relative path of the newest artifact of one source; its absence is an error."""
    own = manifests.where((F.col("source_slug") == contract.slug) & (F.col("operation") == operation))
    newest = M.latest_artifacts(own).first()
    if newest is None:
        raise GateError(f"{contract.slug}: no {operation} manifest found")
    return newest["artifact"]


def source_column_map(spark: SparkSession, path: str, contract: SourceContract) -> dict[str, str]:
    """Observed spelling to API field from frozen metadata, which must be the contract's own."""
    wrong = read_metadata(spark, path).where(~F.col("id").eqNullSafe(F.lit(contract.dataset_id)))
    require_empty(wrong, f"{contract.slug}: metadata identifies another dataset")
    return column_map_dict(column_map(read_column_catalog(spark, path), by="dataset_id"))


def land_latest(
    spark: SparkSession, root: str, contract: SourceContract, manifests: DataFrame, out: str
) -> Source:
    """Land the newest acquisition of a source under its API field names."""
    root = root.rstrip("/")
    metadata = f"{root}/{latest_path(manifests, contract, M.FREEZE)}"
    artifact = latest_path(manifests, contract, M.ACQUIRE)
    names = source_column_map(spark, metadata, contract)
    digest = artifact.rpartition("/")[2].rpartition(".")[0]
    return Source(land_snapshot(spark, f"{root}/{artifact}", out, names), contract, digest)


def strict_table(spark: SparkSession, path: str, short_allowed: bool = True) -> DataFrame:
    """A CSV table with record numbers; records with extra cells, or lacking some, are refused."""
    ragged = ragged_records(spark, path)
    if short_allowed:
        ragged = ragged.where(F.col("kind") == "long")
    require_empty(ragged, f"{path}: records do not fit the header")
    return with_row_number(spark, path).drop("source_file")


def check_public_file(spark: SparkSession, path: str, contract: SourceContract) -> DataFrame:
    """Findings in a CSV meant for publication. Its header is judged before any record is read."""
    check_public_columns(list(resolve_header(read_header(spark, path)).values()), contract)
    return check_public(strict_table(spark, path), contract)


def audit_private_file(
    spark: SparkSession, path: str, contract: SourceContract, names: dict[str, str] | None = None
) -> DataFrame:
    """Findings in the allowlisted columns of a private CSV; its other columns stay unread."""
    require_empty(
        ragged_records(spark, path).where(F.col("kind") == "long"), f"{contract.slug}: records do not fit the header"
    )
    return audit_source(with_row_number(spark, path, names), contract)


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """A review worksheet edited as CSV; every record must have every cell."""
    rows = strict_table(spark, path, short_allowed=False)
    check_review_columns(rows.columns)
    return require_rows(rows, "no review rows")
