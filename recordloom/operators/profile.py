"""Exact column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import blank_to_null
from recordloom.functions.values import is_suspicious, parse_date
from recordloom.operators.limits import top_per_group
from recordloom.operators.schema import CONFIGURED_ROLES
from recordloom.session import stage
from recordloom.sources.contracts import SourceContract
from recordloom.sources.snapshot import FILE, ROW

TOP_VALUES = 25
DATE_EXAMPLES = 5
_BOOKKEEPING = {ROW, FILE}


def observed_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in _BOOKKEEPING]


def null_counts(df: DataFrame) -> DataFrame:
    """(field, rows, nulls) of every observed column: one pass, one row per task to the exchange."""
    columns = observed_columns(df)
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(blank_to_null(F.col(c)).isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    pairs = [
        F.struct(F.lit(c).alias("field"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)
    ]
    return counts.select("rows", F.inline(F.array(*pairs))).select("field", "rows", "nulls")


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n, first_row) of the stripped non-blank values.

    Two-column rows are unpivoted and counted map-side first, so a value filling a third of the table
    crosses the shuffle once per task.
    """
    order = F.col(ROW) if ROW in df.columns else F.lit(None).cast("bigint")
    narrow = df.select(order.alias("_order"), *[blank_to_null(F.col(f)).alias(f) for f in fields])
    long = narrow.unpivot("_order", fields, "field", "value").where(F.col("value").isNotNull())
    return long.groupBy("field", "value").agg(
        F.count("*").alias("n"), F.min("_order").alias("first_row")
    )


def distinct_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, distinct); a field without any value has no row."""
    return distinct_of(value_counts(df, fields))


def distinct_of(counted: DataFrame) -> DataFrame:
    return counted.groupBy("field").agg(F.count("*").alias("distinct"))


def top_values(df: DataFrame, fields: list[str], keep: int = TOP_VALUES) -> DataFrame:
    """(field, rank, value, n): most frequent values, ties by first appearance."""
    return top_of(value_counts(df, fields), keep)


def top_of(counted: DataFrame, keep: int = TOP_VALUES) -> DataFrame:
    order = [F.desc("n"), F.asc_nulls_last("first_row"), F.asc("value")]
    return top_per_group(counted, ["field"], order, keep).select("field", "rank", "value", "n")


def date_ranges(df: DataFrame, fields: list[str], as_of_year: int) -> DataFrame:
    """(field, minimum, maximum, invalid and suspicious counts).

    Chronological extremes in their source spelling; the first spelling wins among equal instants.
    Dates are parsed once per distinct value, not per row.
    """
    return ranges_of(value_counts(df, fields), as_of_year)


def with_dates(counted: DataFrame, fields: list[str]) -> DataFrame:
    """Value counts with ``at``, the instant of each distinct value of the date columns. Written once, it is parsed once."""
    return counted.withColumn("at", F.when(F.col("field").isin(fields), parse_date(F.col("value"))))


def ranges_of(counted: DataFrame, as_of_year: int) -> DataFrame:
    dated = counted if "at" in counted.columns else counted.withColumn("at", parse_date(F.col("value")))
    return dated.groupBy("field").agg(*_range_columns(as_of_year))


def _range_columns(as_of_year: int) -> list[Column]:
    valid = F.col("at").isNotNull()
    suspicious = is_suspicious(F.col("at"), as_of_year)
    first = F.struct("at", "first_row", "value")
    last = F.struct("at", (-F.col("first_row")).alias("o"), "value")
    return [
        F.min_by("value", F.when(valid, first)).alias("minimum"),
        F.max_by("value", F.when(valid, last)).alias("maximum"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid_date_count"),
        F.coalesce(F.sum(F.when(suspicious, F.col("n"))), F.lit(0)).alias("suspicious_date_count"),
    ]


def suspicious_examples(df: DataFrame, fields: list[str], as_of_year: int) -> DataFrame:
    """(field, suspicious_date_examples): the first five distinct suspicious texts, sorted."""
    return examples_of(value_counts(df, fields), as_of_year)


def examples_of(counted: DataFrame, as_of_year: int) -> DataFrame:
    if "at" in counted.columns:
        suspicious = counted.where(is_suspicious(F.col("at"), as_of_year)).select("field", "value", "first_row", "at")
    else:
        # A filter would move below the aggregation and parse every row; the generator parses each
        # distinct value once, where it stands.
        at = F.filter(F.array(parse_date(F.col("value"))), lambda t: is_suspicious(t, as_of_year))
        suspicious = counted.select("field", "value", "first_row", F.explode(at).alias("at"))
    order = [F.asc_nulls_last("first_row"), F.asc("value")]
    first = top_per_group(suspicious.drop("at"), ["field"], order, DATE_EXAMPLES)
    return first.groupBy("field").agg(
        F.array_sort(F.collect_list("value")).alias("suspicious_date_examples")
    )


def duplicate_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, duplicates) = rows − nulls − distinct; null for a field without values."""
    nulls = null_counts(df.select(*fields))
    joined = nulls.join(distinct_counts(df, fields), "field", "left")
    duplicates = F.col("rows") - F.col("nulls") - F.col("distinct")
    return joined.select("field", duplicates.alias("duplicates"))


def row_floor(df: DataFrame, contract: SourceContract) -> DataFrame:
    """(source, row_count, expected_minimum_rows, meets_expected_minimum)."""
    return df.groupBy().agg(F.count("*").alias("row_count")).select(
        F.lit(contract.slug).alias("source"),
        "row_count",
        F.lit(contract.expected_minimum_rows).cast("bigint").alias("expected_minimum_rows"),
        (F.col("row_count") >= contract.expected_minimum_rows).alias("meets_expected_minimum"),
    )


def profile_fields(df: DataFrame, contract: SourceContract, as_of_year: int) -> DataFrame:
    """One row per observed column, from two scans of the snapshot.

    One scan counts the values of the tracked columns; the counts are written once, and distinct values, top
    values, dates and the nulls of tracked columns all come from them. The other counts records, and the nulls of the
    remaining columns. The joined tables have a row per column.
    """
    observed = set(df.columns)
    tracked = [f for f in contract.tracked_fields if f in observed]
    categories = [f for f in contract.fields("category") if f in observed]
    dates = [f for f in contract.fields("date") if f in observed]

    columns = observed_columns(df)
    plain = [c for c in columns if c not in tracked]
    totals = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(blank_to_null(F.col(c)).isNull()).alias(f"n{columns.index(c)}") for c in plain],
    )
    pairs = [
        F.struct(F.lit(c).alias("field"), (F.col(f"n{i}") if c in plain else F.lit(None).cast("bigint")).alias("nulls"))
        for i, c in enumerate(columns)
    ]
    out = totals.select("rows", F.inline(F.array(*pairs)))
    if tracked:
        counted = stage(with_dates(value_counts(df, tracked), dates), "value_counts")
        # One pass over the counts: the date columns' ranges beside every column's distinct values. What it says of the
        # dates of other columns is masked below.
        known = counted.groupBy("field").agg(
            F.count("*").alias("distinct"), F.sum("n").alias("filled"), *(_range_columns(as_of_year) if dates else [])
        )
        out = out.join(F.broadcast(known), "field", "left")
        filled = F.when(F.col("field").isin(tracked), F.coalesce("filled", F.lit(0)))
        out = out.withColumn("nulls", F.coalesce("nulls", F.col("rows") - filled)).drop("filled")
    else:
        out = out.withColumn("distinct", F.lit(None).cast("bigint"))
    out = out.withColumn("null_rate", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")))
    if categories:
        ranked = top_of(counted.where(F.col("field").isin(categories))).groupBy("field").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                lambda t: F.struct(t["value"].alias("value"), t["n"].alias("n")),
            ).alias("top_values")
        )
        out = out.join(F.broadcast(ranked), "field", "left")
    else:
        out = out.withColumn("top_values", F.lit(None).cast("array<struct<value:string,n:bigint>>"))
    if dates:
        examples = examples_of(counted.where(F.col("field").isin(dates)), as_of_year)
        out = out.join(F.broadcast(examples), "field", "left")
    else:
        out = out.select(
            "*",
            *[F.lit(None).cast("string").alias(c) for c in ("minimum", "maximum")],
            *[F.lit(None).cast("bigint").alias(c) for c in ("invalid_date_count", "suspicious_date_count")],
            F.lit(None).cast("array<string>").alias("suspicious_date_examples"),
        )
    is_date = F.col("field").isin(dates)
    is_unique = F.col("field").isin(list(contract.fields("unique")))
    # A date column without any value has counts of zero, not unknown ones.
    for name in ("invalid_date_count", "suspicious_date_count"):
        out = out.withColumn(name, F.when(is_date, F.coalesce(name, F.lit(0).cast("bigint"))))
    out = out.withColumn(
        "suspicious_date_examples",
        F.when(is_date, F.coalesce("suspicious_date_examples", F.array().cast("array<string>"))),
    )
    duplicates = F.when(is_unique, F.col("rows") - F.col("nulls") - F.col("distinct"))
    return out.withColumn("duplicates", duplicates).select(
        F.lit(contract.slug).alias("source"),
        "field", "rows", "nulls", "null_rate", "minimum", "maximum", "distinct", "duplicates",
        "top_values", "invalid_date_count", "suspicious_date_count", "suspicious_date_examples",
    )


def profile_source(df: DataFrame, contract: SourceContract, artifact: str, created_at: str) -> DataFrame:
    """The profile's one-row header; the columns missing from the snapshot are known when planning."""
    missing = sorted(set(contract.fields(*CONFIGURED_ROLES)) - set(df.columns))
    return row_floor(df, contract).select(
        F.lit(1).alias("profile_version"),
        F.lit(created_at).alias("created_at"),
        "source",
        F.lit(contract.dataset_id).alias("dataset_id"),
        F.lit(artifact).alias("artifact"),
        "row_count",
        "expected_minimum_rows",
        "meets_expected_minimum",
        F.array(*[F.lit(m) for m in missing]).cast("array<string>").alias("missing_configured_fields"),
    )


def profile_summary(profiles: DataFrame) -> DataFrame:
    """(source, row_count, meets_expected_minimum, missing_fields) per profile."""
    return profiles.select(
        "source",
        "row_count",
        "meets_expected_minimum",
        F.size("missing_configured_fields").cast("bigint").alias("missing_fields"),
    )
