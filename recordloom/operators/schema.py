"""Column names, contract coverage, classification and the default-deny public schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import canonical_field_name, canonical_header_name
from recordloom.sources.contracts import ContractError, SourceContract

CONFIGURED_ROLES = ("identity", "category", "date", "amount", "unique", "public")


def resolve_header(header: Sequence[str], column_map: Mapping[str, str] | None = None) -> dict[str, str]:
    """API field by raw header cell, in header order; empty and colliding names are refused."""
    resolved: dict[str, str] = {}
    for raw in header:
        canonical = canonical_header_name(raw)
        if not canonical:
            raise ContractError(f"header {raw!r} has no usable name")
        field = (column_map or {}).get(canonical, canonical)
        if field in resolved.values() or raw in resolved:
            raise ContractError(f"more than one header resolves to {field!r}")
        resolved[raw] = field
    return resolved


def resolve_columns(df: DataFrame, column_map: Mapping[str, str] | None = None) -> DataFrame:
    """Rename raw display headers to API fields."""
    return df.toDF(*resolve_header(df.columns, column_map).values())


def catalog_fields(catalog: DataFrame) -> DataFrame:
    """Catalog with ``field`` (API name, display name where it has none) and ``display``."""
    api = canonical_field_name(
        F.coalesce(F.nullif("field_name", F.lit("")), F.col("name"), F.lit(""))
    )
    display = canonical_field_name(F.nullif("name", F.lit("")))
    with_api = catalog.withColumn("field", api)
    return with_api.withColumn("display", F.coalesce(display, F.col("field")))


def name_collisions(catalog: DataFrame, by: str = "source") -> DataFrame:
    """Canonical names shared by several headers of one source, or empty ones."""
    named = catalog.select(by, canonical_field_name(F.col("name")).alias("field"))
    return (
        named.groupBy(by, "field").agg(F.count("*").alias("headers"))
        .where((F.col("headers") > 1) | (F.col("field") == ""))
    )


def header_violations(headers: DataFrame, by: str = "source", header: str = "header") -> DataFrame:
    """(source, rule) for the headers (arrays of cells) of many files at once, by the rules that a scan applies to its own.

    Rules: empty_cell; repeated_cell; unusable_name (a cell without any letter or digit); colliding_names (different cells
    with one canonical name). A missing cell is an empty one, and a header without cells is empty_header. Nothing is shuffled.
    """
    cells = F.transform(header, lambda c: F.coalesce(c, F.lit("")))
    filled = F.array_distinct(F.filter(cells, lambda c: c != ""))
    names = F.transform(filled, canonical_field_name)
    usable = F.filter(names, lambda n: n != "")
    rules = F.array_compact(
        F.array(
            F.when(F.col(header).isNull() | (F.size(header) == 0), "empty_header"),
            F.when(F.array_contains(cells, ""), "empty_cell"),
            F.when(F.size(F.filter(cells, lambda c: c != "")) > F.size(filled), "repeated_cell"),
            F.when(F.size(usable) < F.size(names), "unusable_name"),
            F.when(F.size(F.array_distinct(usable)) < F.size(usable), "colliding_names"),
        )
    )
    return headers.select(by, F.explode(rules).alias("rule"))


def filter_violations(filters: DataFrame, fields: DataFrame) -> DataFrame:
    """(source, field) of row filters on fields that their source does not publish."""
    public = fields.where(F.col("role") == "public").select("source", "field").distinct()
    return filters.select("source", "field").distinct().join(public, ["source", "field"], "left_anti")


def column_order_violations(observed: DataFrame, expected: Sequence[str], by: str = "source") -> DataFrame:
    """(source, column, rule) for tables (source, position, column) whose columns must be the ``expected`` ones in order.

    Rules: missing, unexpected, misplaced (another place than the expected one), repeated. Positions count from 0.
    """
    places = F.create_map(*[F.lit(x) for place, name in enumerate(expected) for x in (name, place)])
    held = observed.groupBy(by, "column").agg(F.count("*").alias("n"), F.min("position").alias("position"))
    place = places[F.col("column")]
    rule = (
        F.when(place.isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(place != F.col("position"), "misplaced")
    )
    wrong = held.select(by, "column", rule.alias("rule")).where(F.col("rule").isNotNull())
    seen = observed.groupBy(by).agg(F.collect_set("column").alias("seen"))
    missing = F.array_except(F.array(*map(F.lit, expected)), "seen")
    return wrong.unionByName(seen.select(by, F.explode(missing).alias("column"), F.lit("missing").alias("rule")))


def column_map(catalog: DataFrame, by: str = "source") -> DataFrame:
    """(source, observed, field, meanings): what each observed spelling stands for.

    ``meanings`` above one marks an ambiguous spelling; its ``field`` is then null.
    """
    spelled = catalog_fields(catalog).select(
        by, "field", F.explode(F.array("field", "display")).alias("observed")
    )
    meanings = spelled.groupBy(by, "observed").agg(
        F.count_distinct("field").alias("meanings"), F.min("field").alias("field")
    )
    field = F.when(F.col("meanings") == 1, F.col("field")).alias("field")
    return meanings.select(by, "observed", field, "meanings")


def column_map_dict(mapping: DataFrame) -> dict[str, str]:
    """The map of one source as a dict. As wide as that source's header, so the driver may hold it."""
    rows = mapping.select("observed", "field", "meanings").collect()
    ambiguous = sorted(row["observed"] for row in rows if row["meanings"] > 1)
    if ambiguous:
        raise ContractError(f"ambiguous column names: {', '.join(ambiguous)}")
    return {row["observed"]: row["field"] for row in rows}


def missing_fields(fields: DataFrame, observed: DataFrame) -> DataFrame:
    """Configured (source, field) pairs that were not observed."""
    configured = fields.where(F.col("role").isin(*CONFIGURED_ROLES)).select("source", "field")
    return configured.distinct().join(observed.select("source", "field"), ["source", "field"], "left_anti")


def _classification_inputs(fields: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    roles = fields.groupBy("source", "field").agg(
        F.bool_or(F.col("role") == "public").alias("is_public"),
        F.bool_or(F.col("role") == "restricted").alias("is_restricted"),
    )
    # As many patterns as the contract of one source lists.
    listed = patterns.groupBy("source").agg(F.collect_set("pattern").alias("patterns"))
    return roles, listed


def _with_roles(observed: DataFrame, fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """Observed fields with contract flags.

    Contract tables made from contracts are local data of known size, so Spark broadcasts them unasked.
    """
    roles, listed = _classification_inputs(fields, patterns)
    joined = observed.join(roles, ["source", "field"], "left").join(listed, "source", "left")
    matches = F.exists("patterns", lambda p: F.lower("field").contains(F.lower(p)))
    return (
        joined.withColumn("is_public", F.coalesce("is_public", F.lit(False)))
        .withColumn(
            "is_restricted",
            F.coalesce("is_restricted", F.lit(False)) | F.coalesce(matches, F.lit(False)),
        )
        .drop("patterns")
    )


def public_schema_violations(
    observed: DataFrame, fields: DataFrame, patterns: DataFrame
) -> DataFrame:
    """(source, field, rule) for columns a public table must not have."""
    flagged = _with_roles(observed.select("source", "field"), fields, patterns)
    rules = F.array_compact(
        F.array(
            F.when(~F.col("is_public"), F.lit("not_allowlisted")),
            F.when(F.col("is_restricted"), F.lit("restricted")),
        )
    )
    return flagged.select("source", "field", F.explode(rules).alias("rule"))


def classify_columns(observed: DataFrame, fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """Observed columns with PUBLIC_ALLOWLISTED, RESTRICTED or INTERNAL_REVIEW."""
    label = (
        F.when(F.col("is_public"), "PUBLIC_ALLOWLISTED")
        .when(F.col("is_restricted"), "RESTRICTED")
        .otherwise("INTERNAL_REVIEW")
    )
    flagged = _with_roles(observed, fields, patterns)
    return flagged.withColumn("classification", label).drop("is_public", "is_restricted")


def field_dictionary(catalog: DataFrame, fields: DataFrame, patterns: DataFrame) -> DataFrame:
    """Catalog columns with type, classification and description, then configured fields it lacks."""
    named = catalog_fields(catalog)
    listed = classify_columns(named, fields, patterns).select(
        "source",
        "position",
        "field",
        F.coalesce("name", F.lit("")).alias("display_name"),
        F.coalesce("data_type", F.lit("")).alias("data_type"),
        "classification",
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit(True).alias("in_catalog"),
    )
    absent = missing_fields(fields, named)
    lacking = classify_columns(absent, fields, patterns).withColumn("in_catalog", F.lit(False))
    return listed.unionByName(lacking, allowMissingColumns=True)


def public_projection(df: DataFrame, contract: SourceContract) -> DataFrame:
    """The allowlisted fields in allowlist order; other columns are never read."""
    contract.require_fields(df.columns, contract.public_fields)
    return df.select(*contract.public_fields)


def check_public_columns(columns: Sequence[str], contract: SourceContract) -> None:
    """Refuse a public table by its column list alone, before anything is scanned."""
    unexpected = sorted(set(columns) - set(contract.public_fields))
    restricted = sorted(c for c in columns if contract.is_restricted(c))
    if unexpected or restricted:
        raise ContractError(
            f"{contract.slug}: public schema rejected; "
            f"not allowlisted: {', '.join(unexpected) or 'none'}; "
            f"restricted: {', '.join(restricted) or 'none'}"
        )
