"""Joins with the newest entry at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.session import stage

#: Entries that are broadcast at most; more take the other way.
BROADCAST_ENTRIES = 100_000


def newest_at(rows: DataFrame, entries: DataFrame, key: str, at: str, value: str, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """``rows`` with ``value`` of the newest entry of their ``key`` at or before ``at``; null if there is none.

    ``entries`` holds (key, at, value); times are compared as they are, so text must sort by time. Of entries of one key and time the
    greatest value counts. Null keys and times find nothing, and entries without either are never found.

    The entries, which are counted first, become intervals of validity. A small table of them is broadcast and the rows stay
    where they are. A large one is merged with the rows in the order of time, key by key; Spark sorts
    and streams each key, so a key that holds a third of all rows costs time, not memory.
    """
    known = entries.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    single = stage(known.groupBy(key, at).agg(F.max(value).alias(value)), "as_of_entries")
    if single.count() <= broadcast_entries:
        until = F.lead(at).over(W.partitionBy(key).orderBy(at))
        intervals = single.select(F.col(key).alias("_key"), F.col(at).alias("_from"), until.alias("_until"), F.col(value).alias(value))
        inside = (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
        return rows.join(F.broadcast(intervals), (F.col(key) == F.col("_key")) & inside, "left").drop("_key", "_from", "_until")
    both = single.select(key, at, F.col(value).alias("_value"), F.lit(0).alias("_is_row")).unionByName(
        rows.select(key, at, F.struct("*").alias("_row"), F.lit(1).alias("_is_row")), allowMissingColumns=True
    )
    # At equal times entries come first. Before the first entry of a key there is nothing to repeat.
    order = W.partitionBy(key).orderBy(F.col(at).asc_nulls_first(), "_is_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = both.withColumn("_value", F.last("_value", ignorenulls=True).over(order)).where("_is_row = 1")
    found = F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.col("_value"))
    return merged.select("_row.*", found.alias(value))
