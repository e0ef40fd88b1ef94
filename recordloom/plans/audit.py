"""Population and overlap figures of the two domains."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.values import AMOUNT_TYPE
from recordloom.operators.entities import placeholder_stats
from recordloom.plans.candidates import Source, staged_names


@dataclass(frozen=True)
class IdentityAudit:
    campaign: DataFrame
    public: DataFrame
    candidates: DataFrame
    suspicious_dates: DataFrame
    matched_campaign_keys: DataFrame


def _nonblank(column: str):
    return F.nullif(column, F.lit(""))


def campaign_population(names: DataFrame) -> DataFrame:
    """(rows, raw_names, strict_name_keys, suffix_candidate_keys, amount)."""
    return names.groupBy().agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_distinct("name").alias("raw_names"),
        F.count_distinct("strict_key").alias("strict_name_keys"),
        F.count_distinct(_nonblank("suffix_key")).alias("suffix_candidate_keys"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast(AMOUNT_TYPE).alias("amount"),
    )


def public_population(names: DataFrame) -> DataFrame:
    """Eligible rows, raw names, codes and keys per source."""
    return names.groupBy("source").agg(
        F.sum("rows").alias("eligible_rows"),
        F.count_distinct("name").alias("eligible_raw_names"),
        F.count_distinct("code").alias("eligible_codes"),
        F.count_distinct("strict_key").alias("strict_name_keys"),
        F.count_distinct(_nonblank("suffix_key")).alias("suffix_candidate_keys"),
    )


def key_overlap(campaign: DataFrame, public: DataFrame, key: str, name: str) -> DataFrame:
    """(source, name): distinct non-blank keys a source shares with the campaign side."""
    ours = campaign.where(F.col(key) != "").select(key).distinct()
    theirs = public.where(F.col(key) != "").select("source", key).distinct()
    return theirs.join(ours, key, "left_semi").groupBy("source").agg(F.count("*").alias(name))


def matched_campaign_keys(campaign: DataFrame, public: DataFrame) -> DataFrame:
    """Campaign strict keys that any source matches, strictly or without legal suffixes."""
    keys = campaign.select("strict_key", "suffix_key").distinct()
    strict = keys.join(public.select("strict_key").distinct(), "strict_key", "left_semi")
    public_suffixes = public.where(F.col("suffix_key") != "").select("suffix_key").distinct()
    suffix = keys.join(public_suffixes, "suffix_key", "left_semi")
    return strict.select("strict_key").union(suffix.select("strict_key")).distinct()


def placeholder_summary(public: Sequence[Source]) -> DataFrame:
    stats = placeholder_stats(public[0].df, public[0].contract)
    for source in public[1:]:
        stats = stats.unionByName(placeholder_stats(source.df, source.contract))
    return stats.select(
        "source",
        F.col("rows").alias("invalid_code_rows"),
        F.col("distinct_names").alias("invalid_code_names"),
        F.col("distinct_codes").alias("invalid_codes"),
    )


def candidate_counters(candidates: DataFrame) -> DataFrame:
    """(dimension, value, candidates): by tier, by source, distinct campaign keys, reviewed rows."""
    by_group = candidates.groupingSets(
        [["evidence_tier"], ["public_record_source"]], "evidence_tier", "public_record_source"
    ).agg(F.grouping("evidence_tier").alias("g"), F.count("*").alias("candidates"))
    groups = by_group.select(
        F.when(F.col("g") == 0, "evidence_tier").otherwise("public_record_source").alias("dimension"),
        F.coalesce("evidence_tier", "public_record_source").alias("value"),
        "candidates",
    )
    reviewed = F.coalesce(F.trim("review_status"), F.lit("")) != "UNREVIEWED"
    totals = candidates.groupBy().agg(
        F.count_distinct("strict_campaign_key").alias("campaign_keys"),
        F.count_if(reviewed).alias("reviewed_rows"),
    )
    return groups.unionByName(
        totals.unpivot([], ["campaign_keys", "reviewed_rows"], "value", "candidates").select(
            F.lit("all").alias("dimension"), "value", "candidates"
        )
    )


def suspicious_dates(profile_fields: DataFrame) -> DataFrame:
    """Fields with suspicious dates across the newest profiles."""
    return profile_fields.where(F.col("suspicious_date_count") > 0).select(
        "source", "field", "suspicious_date_count", "suspicious_date_examples"
    )


def public_audit(campaign: DataFrame, names: DataFrame, public: Sequence[Source]) -> DataFrame:
    """One row per public source, also for a source without an eligible row."""
    spark = campaign.sparkSession
    listed = spark.createDataFrame(
        [(s.contract.slug, ",".join(s.contract.code_prefixes), s.artifact_sha256) for s in public],
        "source string, invalid_code_prefixes string, artifact_sha256 string",
    )
    out = (
        listed.join(public_population(names), "source", "left")
        .join(key_overlap(campaign, names, "strict_key", "exact_strict_key_overlap"), "source", "left")
        .join(key_overlap(campaign, names, "suffix_key", "legal_suffix_key_overlap"), "source", "left")
        .join(placeholder_summary(public), "source", "left")
    )
    return out.fillna(0)


def identity_audit(
    campaign: Source,
    public: Sequence[Source],
    candidates: DataFrame,
    profile_fields: DataFrame,
    names: tuple[DataFrame, DataFrame] | None = None,
) -> IdentityAudit:
    left, right = names or staged_names(campaign, public)
    return IdentityAudit(
        campaign=campaign_population(left).withColumn(
            "artifact_sha256", F.lit(campaign.artifact_sha256)
        ),
        public=public_audit(left, right, public),
        candidates=candidate_counters(candidates),
        suspicious_dates=suspicious_dates(profile_fields),
        matched_campaign_keys=matched_campaign_keys(left, right).groupBy().agg(
            F.count("*").alias("matched_campaign_keys")
        ),
    )
