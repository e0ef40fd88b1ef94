"""Organizations of one source: names, keys, rows and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.pii import contains_pii
from recordloom.functions.text import has_code_prefix, strict_name_key, strip, suffix_of_strict_key
from recordloom.functions.values import AMOUNT_TYPE, parse_amount
from recordloom.operators.checks import GateError
from recordloom.sources.contracts import SourceContract
from recordloom.sources.snapshot import ROW

NAME_COLUMNS = ("source", "strict_key", "suffix_key", "code", "name", "rows", "amount", "first_row")


def _name_counts(df: DataFrame, contract: SourceContract, code: Column, eligible: Column) -> DataFrame:
    """Rows and amount per raw (name, code), before any text rule runs.

    The text rules cost far more than counting, and a snapshot repeats its names: they run once per
    distinct name instead of once per row, and the shuffle carries pre-aggregated names.
    """
    amount = F.lit(0).cast(AMOUNT_TYPE)
    if contract.candidate_amount:
        amount = parse_amount(F.col(contract.candidate_amount))
    order = F.col(ROW) if ROW in df.columns else F.lit(None).cast("bigint")
    cells = df.where(eligible).select(
        strip(F.col(contract.name_field)).alias("name"),
        code.alias("code"),
        amount.alias("amount"),
        order.alias("_order"),
    )
    return cells.groupBy("name", "code").agg(
        F.count("*").alias("rows"),
        F.sum("amount").alias("amount"),
        F.min("_order").alias("first_row"),
    )


def _keyed(counted: DataFrame, contract: SourceContract) -> DataFrame:
    """Names that are neither blank nor PII-shaped, with their keys; empty keys are dropped.

    The name test also mentions the row count, which keeps Catalyst from moving it below the
    aggregation and back to every row. An empty key leaves through the explode, so each key is
    computed once instead of once to filter and once to keep.
    """
    safe = F.when(F.col("rows") > 0, (F.col("name") != "") & ~contains_pii(F.col("name")))
    key = F.filter(F.array(strict_name_key(F.col("name"))), lambda k: k != "")
    keyed = counted.where(safe).select("*", F.explode(key).alias("strict_key"))
    keyed = keyed.withColumn("suffix_key", suffix_of_strict_key(F.col("strict_key")))
    return keyed.withColumn("source", F.lit(contract.slug)).select(*NAME_COLUMNS)


def campaign_names(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Names of rows explicitly typed as organizations, one row per raw name."""
    if not (contract.name_field and contract.type_field and contract.type_values):
        raise GateError(f"{contract.slug}: no organization type controls in the contract")
    contract.require_fields(
        df.columns, [contract.name_field, contract.type_field, contract.candidate_amount]
    )
    allowed = [value.lower() for value in contract.type_values]
    typed = F.lower(strip(F.col(contract.type_field))).isin(allowed)
    return _keyed(_name_counts(df, contract, F.lit(""), typed), contract)


def public_names(df: DataFrame, contract: SourceContract) -> DataFrame:
    """Names of rows without a placeholder code, one row per raw (name, code). A missing code cell counts as blank."""
    if not contract.name_field:
        raise GateError(f"{contract.slug}: no organization name field in the contract")
    contract.require_fields(
        df.columns, [contract.name_field, contract.code_field, contract.candidate_amount]
    )
    code = strip(F.coalesce(F.col(contract.code_field), F.lit(""))) if contract.code_field else F.lit("")
    eligible = ~has_code_prefix(code, contract.code_prefixes)
    return _keyed(_name_counts(df, contract, code, eligible), contract)


def _display_order() -> Column:
    return F.struct(-F.col("rows"), F.lower("name"), "first_row", "name")


def entities(names: DataFrame) -> DataFrame:
    """One row per (source, strict_key, code): rows, amount and the most frequent raw name.

    Ties of the display name go to the alphabetically first, letter case aside. Campaign names have
    the empty code, so their entities are one per strict key.
    """
    return names.groupBy("source", "strict_key", "suffix_key", "code").agg(
        F.sum("rows").alias("rows"),
        F.sum("amount").cast(AMOUNT_TYPE).alias("amount"),
        F.min_by("name", _display_order()).alias("display_name"),
    )


def name_lists(names: DataFrame) -> DataFrame:
    """(source, strict_key, code, names): sorted raw spellings, the content of one evidence cell.

    Callers keep only the entities they show before asking for this.
    """
    return names.groupBy("source", "strict_key", "code").agg(
        F.array_sort(F.collect_set("name")).alias("names")
    )


def keys_per_suffix(names: DataFrame) -> DataFrame:
    """(suffix_key, strict_keys): distinct strict keys behind each suffix key, over all sources."""
    keyed = names.where(F.col("suffix_key") != "").select("suffix_key", "strict_key").distinct()
    return keyed.groupBy("suffix_key").agg(F.count("*").alias("strict_keys"))


def placeholder_stats(df: DataFrame, contract: SourceContract) -> DataFrame:
    """(source, rows, distinct_names, distinct_codes) of the rows with a placeholder code."""
    source = F.lit(contract.slug).alias("source")
    if not (contract.code_field and contract.name_field):
        zero = F.lit(0).cast("bigint")
        return df.sparkSession.range(1).select(
            source, zero.alias("rows"), zero.alias("distinct_names"), zero.alias("distinct_codes")
        )
    code = strip(F.col(contract.code_field))
    counted = (
        df.where(has_code_prefix(F.col(contract.code_field), contract.code_prefixes))
        .groupBy(code.alias("code"), strip(F.col(contract.name_field)).alias("name"))
        .agg(F.count("*").alias("rows"))
    )
    return counted.groupBy().agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_distinct(F.nullif("name", F.lit(""))).alias("distinct_names"),
        F.count_distinct("code").alias("distinct_codes"),
    ).select(source, "rows", "distinct_names", "distinct_codes")
