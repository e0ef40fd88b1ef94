"""The publisher's column catalog (dataset metadata documents)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.documents import read_json

METADATA_SCHEMA = (
    "id string, columns array<struct<name: string, fieldName: string, dataTypeName: string, "
    "description: string>>, rowsUpdatedAt bigint, publicationDate bigint, viewLastModified bigint"
)


def read_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per metadata document, with the file it came from."""
    return read_json(spark, path, METADATA_SCHEMA).withColumnRenamed("path", "source_file")


def read_column_catalog(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(dataset_id, position, name, field_name, data_type, description), one row per column."""
    columns = read_metadata(spark, path).select(
        F.col("id").alias("dataset_id"), F.posexplode("columns").alias("position", "c")
    )
    return columns.select(
        "dataset_id",
        "position",
        F.col("c.name").alias("name"),
        F.col("c.fieldName").alias("field_name"),
        F.col("c.dataTypeName").alias("data_type"),
        F.col("c.description").alias("description"),
    )
