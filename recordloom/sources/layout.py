"""Tables laid out by a key, so that joins and groups on it need no exchange on their side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def lay_out(rows: DataFrame, path: str, key: str, buckets: int | None = None) -> DataFrame:
    """Write ``rows`` in ``buckets`` parts by the hash of ``key``, each sorted by it, and open the table.

    There is one file for each part; without a number there are as many as shuffle partitions.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
    name = _name()
    writer.mode("errorifexists").saveAsTable(name)
    return spark.table(name)


def open_layout(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that ``lay_out`` has written in another session, with its layout."""
    columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in spark.read.parquet(path).schema.fields)
    name = _name()
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def _name() -> str:
    return f"laid_out_{uuid.uuid4().hex}"
