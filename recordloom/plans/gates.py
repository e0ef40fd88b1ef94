"""Consistency gates over manifests, profiles, fixtures and summaries. Each returns its violations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.checks import explode_rules
from recordloom.operators.privacy import check_public
from recordloom.sources.contracts import Inventory
from recordloom.sources.manifests import ACQUIRE, FREEZE

MANIFEST_VERSION = 1
PROFILE_VERSION = 1


def is_safe_path(path: Column) -> Column:
    """Relative, not empty, and never climbing out of its root."""
    return F.coalesce(
        (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False)
    )


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(.)\.[^.]*$", "$1")


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def path_parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def manifest_violations(manifests: DataFrame, sources: DataFrame) -> DataFrame:
    """(manifest, rule_position, rule). ``sources`` is the contract table."""
    known = sources.select(F.col("source").alias("source_slug"), F.col("dataset_id").alias("expected"))
    joined = manifests.join(known, "source_slug", "left")
    artifact, digest, size = F.col("artifact"), F.col("receipt.sha256"), F.col("receipt.bytes")
    operation = F.coalesce("operation", F.lit(""))

    def unless(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    def placed(folder: str, suffix: str) -> Column:
        parent = F.concat(F.lit(f"data/{folder}/"), F.col("expected"))
        return (path_parent(artifact) == parent) & (path_suffix(artifact) == suffix)

    rules = [
        ("version", unless(F.col("manifest_version") == MANIFEST_VERSION)),
        ("unknown_source", F.col("expected").isNull()),
        ("dataset_id", F.col("expected").isNotNull() & unless(F.col("dataset_id") == F.col("expected"))),
        ("receipt", F.col("receipt").isNull()),
        ("sha256", F.col("receipt").isNotNull() & unless(F.length(digest) == 64)),
        ("bytes", F.col("receipt").isNotNull() & unless(size > 0)),
        ("artifact_path", ~is_safe_path(artifact)),
        ("artifact_name", unless(path_stem(artifact) == digest)),
        ("metadata_location", (operation == FREEZE) & unless(placed("metadata", ".json"))),
        ("raw_location", (operation == ACQUIRE) & unless(placed("raw", ".csv"))),
        ("operation", ~operation.isin(ACQUIRE, FREEZE)),
    ]
    return explode_rules(joined, rules, ["manifest"])


def profile_violations(profiles: DataFrame, sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """(profile_file, rule_position, rule) for profile headers."""
    contract = sources.select(
        "source",
        F.col("dataset_id").alias("expected_id"),
        F.col("expected_minimum_rows").alias("expected_floor"),
    )
    joined = profiles.join(contract, "source", "left")
    known = F.col("expected_id").isNotNull()

    def unless(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    floor_met = F.col("row_count") >= F.col("expected_floor")
    rules = [
        ("version", unless(F.col("profile_version") == PROFILE_VERSION)),
        ("unknown_source", ~known),
        ("dataset_id", known & unless(F.col("dataset_id") == F.col("expected_id"))),
        ("row_floor", known & unless(F.col("expected_minimum_rows") == F.col("expected_floor"))),
        ("row_count", unless(F.col("row_count") >= 0)),
        ("floor_result", known & unless(F.col("meets_expected_minimum") == floor_met)),
    ]
    header = explode_rules(joined, rules, ["profile_file"])
    acquired = manifests.where(F.col("operation") == ACQUIRE).select(
        F.col("source_slug").alias("source"), "artifact"
    ).distinct()
    orphans = profiles.join(acquired, ["source", "artifact"], "left_anti").select(
        "profile_file",
        F.lit(len(rules)).alias("rule_position"),
        F.lit("artifact_without_manifest").alias("rule"),
    )
    return header.unionByName(orphans)


def coverage_violations(
    sources: DataFrame, manifests: DataFrame, profiles: DataFrame, fixtures: DataFrame
) -> DataFrame:
    """(source, rule): sources without frozen metadata, profile or fixture."""
    frozen = manifests.where(F.col("operation") == FREEZE).select(F.col("source_slug").alias("source"))
    out = None
    for present, rule in ((frozen, "no_metadata"), (profiles, "no_profile"), (fixtures, "no_fixture")):
        lacking = sources.select("source").join(present.select("source").distinct(), "source", "left_anti")
        lacking = lacking.select("source", F.lit(rule).alias("rule"))
        out = lacking if out is None else out.unionByName(lacking)
    return out


def fixture_violations(fixtures: Mapping[str, DataFrame], inventory: Inventory) -> DataFrame:
    """(source, field, kind, findings) of the scans of all fixtures."""
    out = None
    for slug, fixture in fixtures.items():
        found = check_public(fixture, inventory.require(slug)).groupBy("field", "kind").agg(
            F.count("*").alias("findings")
        )
        found = found.select(F.lit(slug).alias("source"), "field", "kind", "findings")
        out = found if out is None else out.unionByName(found)
    return out


def gate_summary(
    manifests: DataFrame, profiles: DataFrame, fixtures: DataFrame, summaries: DataFrame
) -> DataFrame:
    """(artifact_kind, checked): how many documents each gate looked at."""
    frozen = manifests.where(F.col("operation") == FREEZE)
    kinds = [
        (manifests, "manifests"), (frozen, "metadata_artifacts"), (profiles, "profiles"),
        (fixtures, "fixtures"), (summaries, "review_summaries"),
    ]
    out = None
    for table, kind in kinds:
        counted = table.groupBy().agg(F.count("*").alias("checked")).select(
            F.lit(kind).alias("artifact_kind"), "checked"
        )
        out = counted if out is None else out.unionByName(counted)
    return out
