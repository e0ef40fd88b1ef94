"""Writers for results, and the row count of an output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.operators.checks import require_empty
from recordloom.operators.privacy import check_public
from recordloom.plans.candidates import EVIDENCE, WORKSHEET, as_text, text_columns
from recordloom.sources.contracts import SourceContract
from recordloom.sources.publish import publish, published
from recordloom.sources.snapshot import ROW


def write_candidates(candidates: DataFrame, path: str, csv: bool = False) -> None:
    """The candidate worksheet in its published column order."""
    text = as_text(candidates).select(*EVIDENCE, *WORKSHEET)
    if csv:
        text.write.csv(path, header=True, escape='"', emptyValue="")
    else:
        text.write.parquet(path)


def publish_candidates(candidates: DataFrame, path: str, run: str, csv: bool = False) -> int:
    """Publish the worksheet as one run, in its order; returns its rows.

    Every pair must have an id of its own: repeated ids are counted while they are written, and refuse the run.
    """
    again = F.row_number().over(W.partitionBy("candidate_id").orderBy("position")) > 1
    flagged = candidates.withColumn("_again", again).orderBy("position")
    ordered = flagged.select(*text_columns(), "_again")
    options = {"header": "true", "escape": '"', "emptyValue": ""} if csv else {}
    return publish(ordered, path, run, {"repeated_candidate_ids": F.col("_again")}, ("_again",), "csv" if csv else "parquet", **options)


def write_profile(profile: DataFrame, path: str, run: str, json: bool = False) -> None:
    """Profile rows, one folder for each source and run. A run that is repeated replaces its own rows and no others."""
    writer = profile.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "run")
    (writer.option("ignoreNullFields", "false").json if json else writer.parquet)(path)


def write_report(report: DataFrame, path: str) -> None:
    """An audit table or a one-row summary as JSON lines."""
    report.write.option("ignoreNullFields", "false").json(path)


def write_fixture(fixture: DataFrame, contract: SourceContract, path: str) -> None:
    """A redacted fixture as CSV; refused if its own scan finds anything."""
    require_empty(check_public(fixture, contract), f"{contract.slug}: fixture failed its scan")
    ordered = fixture.orderBy(ROW).drop(ROW) if ROW in fixture.columns else fixture
    ordered.write.csv(path, header=True, escape='"', emptyValue="")


def output_rows(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """(rows): record count of an output. A published one was counted while it was written; others are read."""
    known = published(spark, path)
    if known is not None:
        return spark.range(1).select(F.lit(known["rows"]).cast("bigint").alias("rows"))
    options = {"header": "true", "multiLine": "true", "escape": '"'} if format == "csv" else {}
    return spark.read.format(format).options(**options).load(path).groupBy().agg(F.count("*").alias("rows"))
