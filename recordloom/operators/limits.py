"""Ranking and limits that keep only what the result needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRICT = "A_STRICT"
SUFFIX = "B_LEGAL_SUFFIX"


_GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], keep: int, rank: str = "rank"
) -> DataFrame:
    """First ``keep`` rows of each group in a total order, with their ``rank``.

    Up to its threshold Spark cuts every group to ``keep`` rows in each task before the shuffle, so a
    group holding most rows is never gathered whole. Past the threshold it would be: groups are then
    cut in salted parts first, which keeps the same rows.
    """
    spark = df.sparkSession
    if keep > int(spark.conf.get(_GROUP_LIMIT_CONF, "1000")):
        # Any split of a group will do: no row of its first ``keep`` ranks lower within a part.
        part = F.pmod(F.xxhash64(*df.columns), F.lit(_SALTS)).alias("_part")
        salted = df.select("*", part)
        by_part = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
        df = salted.withColumn("_in_part", by_part).where(F.col("_in_part") <= keep)
        df = df.drop("_part", "_in_part")
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= keep)


def stratified_limit(rows: DataFrame, limit: int, order: list[Column], tier: str = "evidence_tier") -> DataFrame:
    """Half of ``limit`` (rounded up) from the strict tier, the rest from the other, then backfill.

    The best ``limit`` rows of each tier are all that can be chosen, so each tier is cut by a
    distributed top-k first and the ranking runs over at most ``2 * limit`` rows. Adds ``position``.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    best = [
        rows.where(F.col(tier) == name).orderBy(*order).limit(limit) for name in (STRICT, SUFFIX)
    ]
    pool = best[0].unionByName(best[1])
    share = (limit + 1) // 2
    in_tier = F.row_number().over(W.partitionBy(tier).orderBy(*order))
    overall = F.row_number().over(W.orderBy((F.col(tier) != STRICT).cast("int"), *order))
    ranked = pool.select("*", in_tier.alias("_in_tier"), overall.alias("_overall"))
    phase = (
        F.when((F.col(tier) == STRICT) & (F.col("_in_tier") <= share), 0)
        .when((F.col(tier) == SUFFIX) & (F.col("_in_tier") <= limit - share), 1)
        .otherwise(2)
    )
    position = F.row_number().over(W.orderBy(phase, "_overall"))
    chosen = ranked.withColumn("position", position).where(F.col("position") <= limit)
    return chosen.drop("_in_tier", "_overall")


def later_occurrences(df: DataFrame, key: str, order: str, salts: int = 16) -> DataFrame:
    """Rows whose key occurred before.

    First occurrences come from a map-side aggregation. They are joined back on (key, salt), each
    repeated once per salt, so a key holding a third of the rows is spread over several tasks.
    """
    repeated = (
        df.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .select(F.col(key), "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    )
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)).cast("int"))
    later = salted.join(repeated, [key, "_salt"]).where(F.col(order) > F.col("_first"))
    return later.select(*df.columns)
