"""Which content a store holds, by hash: a table that is looked up instead of listing the store.

Rows lie in folders by the first digits of their hash, below that by the batch that added them. A lookup joins the index
with the wanted rows, so Spark reads only the folders of hashes that are wanted (dynamic partition pruning), however large
the store has grown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.listing import path_exists
from recordloom.sources.manifests import list_files, relative_path

#: Hex digits that name a folder: 256 folders.
PREFIX_DIGITS = 2
INDEX_SCHEMA = "artifact string, prefix string, batch bigint"
#: The batch that holds what was stored before there was an index.
FIRST_BATCH = -1


def content_hash(artifact: Column) -> Column:
    """An artifact is named by its hash."""
    return F.regexp_extract(artifact, r"([^/.]*)(?:\.[^/]*)?$", 1)


def _keyed(artifacts: DataFrame) -> DataFrame:
    digest = content_hash(F.col("artifact"))
    # The condition on the length tells Spark that the wanted rows are few, too.
    return artifacts.select("artifact").where(F.length(digest) == 64).distinct().withColumn("prefix", F.substring(digest, 1, PREFIX_DIGITS))


def add_to_index(artifacts: DataFrame, index: str, batch: int) -> None:
    """Add the artifacts (by ``artifact``) of one batch. Added again, they replace themselves."""
    rows = _keyed(artifacts).withColumn("batch", F.lit(batch).cast("bigint"))
    # One file for each prefix: rows are dealt by it.
    writer = rows.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("prefix", "batch").parquet(index)


def build_index(spark: SparkSession, root: str, index: str) -> None:
    """Index a store that has none, by listing it once."""
    add_to_index(list_files(spark, root).select(relative_path(F.col("path"), root).alias("artifact")), index, FIRST_BATCH)


def stored_among(spark: SparkSession, artifacts: DataFrame, index: str) -> DataFrame:
    """(artifact): those of the wanted artifacts that are stored. ``artifacts`` is one batch of bounded size, and is broadcast."""
    wanted = F.broadcast(_keyed(artifacts))
    if not path_exists(spark, index):
        return wanted.select("artifact").limit(0)
    held = spark.read.schema(INDEX_SCHEMA).parquet(index)
    return held.join(wanted, ["prefix", "artifact"], "left_semi").select("artifact").distinct()
