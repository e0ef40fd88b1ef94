"""Candidate organization pairs across the two domains."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.digests import candidate_id
from recordloom.functions.urls import source_rows_url
from recordloom.operators.asof import newest_at
from recordloom.operators.checks import require_rows
from recordloom.operators.entities import (
    campaign_names,
    entities,
    name_lists,
    public_names,
)
from recordloom.operators.limits import STRICT, SUFFIX, stratified_limit, top_per_group
from recordloom.session import stage
from recordloom.sources.contracts import SourceContract
from recordloom.sources.manifests import ACQUIRE

# The evidence columns in their published order.
EVIDENCE = (
    "candidate_id",
    "evidence_tier",
    "campaign_name",
    "campaign_names_aggregated",
    "public_record_name",
    "public_record_names_aggregated",
    "public_record_source",
    "public_record_code",
    "strict_campaign_key",
    "strict_public_key",
    "suffix_candidate_key",
    "campaign_rows",
    "public_record_rows",
    "campaign_amount_field",
    "campaign_amount",
    "public_record_amount_field",
    "public_record_amount",
    "campaign_artifact_sha256",
    "public_record_artifact_sha256",
    "campaign_source_rows_url",
    "public_record_source_rows_url",
    "campaign_keys_for_suffix",
    "public_keys_for_suffix",
)
# The worksheet columns that follow the evidence.
WORKSHEET = ("review_status", "same_organization", "external_evidence_url", "review_notes")
NAME_SEPARATOR = " | "


@dataclass(frozen=True)
class Source:
    """A landed snapshot, its contract and the hash that names its artifact."""

    df: DataFrame
    contract: SourceContract
    artifact_sha256: str = ""


def staged_names(campaign: Source, public: Sequence[Source]) -> tuple[DataFrame, DataFrame]:
    """The two name tables, computed once and written out; every later step reads these."""
    left = stage(campaign_names(campaign.df, campaign.contract), "campaign-names")
    right = public_names(public[0].df, public[0].contract)
    for source in public[1:]:
        right = right.unionByName(public_names(source.df, source.contract))
    return left, stage(right, "public-names")


def ranking() -> list[Column]:
    """Order of candidates. Evidence first, then keys, so that it is total and reproducible."""
    return [
        (F.col("evidence_tier") != STRICT).cast("int"),
        F.desc("campaign_rows"),
        F.desc("public_record_rows"),
        F.lower("campaign_name"),
        F.lower("public_record_name"),
        F.col("strict_campaign_key"),
        F.col("strict_public_key"),
        F.col("public_record_source"),
        F.col("public_record_code"),
    ]


def _campaign_side(names: DataFrame) -> DataFrame:
    return entities(names).select(
        F.col("strict_key").alias("strict_campaign_key"),
        F.col("suffix_key").alias("suffix_candidate_key"),
        F.col("display_name").alias("campaign_name"),
        F.col("rows").alias("campaign_rows"),
        F.col("amount").alias("campaign_amount"),
    )


def _public_side(names: DataFrame) -> DataFrame:
    return entities(names).select(
        F.col("source").alias("public_record_source"),
        F.col("code").alias("public_record_code"),
        F.col("strict_key").alias("strict_public_key"),
        F.col("suffix_key").alias("suffix_candidate_key"),
        F.col("display_name").alias("public_record_name"),
        F.col("rows").alias("public_record_rows"),
        F.col("amount").alias("public_record_amount"),
    )


def _campaign_order() -> list[Column]:
    return [F.desc("campaign_rows"), F.lower("campaign_name"), F.col("strict_campaign_key")]


def _public_order() -> list[Column]:
    keys = ("strict_public_key", "public_record_source", "public_record_code")
    return [F.desc("public_record_rows"), F.lower("public_record_name"), *map(F.col, keys)]


def strict_pairs(campaign: DataFrame, public: DataFrame, limit: int) -> DataFrame:
    """Pairs with equal strict keys that can rank among the first ``limit``."""
    public = top_per_group(public, ["strict_public_key"], _public_order(), limit, "_rank").drop("_rank")
    left = campaign.drop("suffix_candidate_key")
    joined = left.join(public, F.col("strict_campaign_key") == F.col("strict_public_key"))
    return joined.withColumn("evidence_tier", F.lit(STRICT))


def suffix_pairs(campaign: DataFrame, public: DataFrame, limit: int) -> DataFrame:
    """Pairs that agree only without their legal suffixes and can rank among the first ``limit``.

    A pair that at least ``limit`` other pairs of its own suffix group precede can never
    be chosen, and ranks show that before anything is paired. Order each side of a group by the
    columns of the ranking that it owns. Pairs made from the first ``i`` campaign and the first ``j``
    public entries all precede pair (i, j); at most ``j`` of those ``i * j`` are strict pairs (a public
    entry equals at most one campaign key), so (i, j) is needed only while ``j * (i - 1) <= limit``.
    Entries of one strict key beyond its first ``limit`` are never needed, and among the first
    ``2 * limit`` of the rest at least ``limit`` differ from any given campaign key. So a group of any
    size contributes a number of pairs bounded by the limit, and the result stays exact.
    """
    campaign = campaign.where(F.col("suffix_candidate_key") != "")
    public = public.where(F.col("suffix_candidate_key") != "")
    suffix = ["suffix_candidate_key"]
    campaign = top_per_group(campaign, suffix, _campaign_order(), limit + 1, "_i")
    per_key = [*suffix, "strict_public_key"]
    public = top_per_group(public, per_key, _public_order(), limit, "_rank").drop("_rank")
    public = top_per_group(public, suffix, _public_order(), 2 * limit, "_j")
    differ = F.col("strict_campaign_key") != F.col("strict_public_key")
    condition = differ & (F.col("_j") * (F.col("_i") - 1) <= limit)
    left, right = campaign.alias("c"), public.alias("p")
    same = F.col("c.suffix_candidate_key") == F.col("p.suffix_candidate_key")
    joined = left.join(right, same & condition).drop(F.col("c.suffix_candidate_key"))
    return joined.drop("_i", "_j").withColumn("evidence_tier", F.lit(SUFFIX))


def candidate_counts(campaign: DataFrame, public: DataFrame) -> DataFrame:
    """(public_record_source, evidence_tier, pairs): how many pairs there are in all, without making them.

    A suffix group holds as many pairs as the product of its sides, strict pairs among them.
    """
    ours = campaign.select("strict_key", "suffix_key").distinct()
    theirs = public.select("source", "strict_key", "suffix_key", "code").distinct()
    strict = theirs.join(ours.select("strict_key"), "strict_key", "left_semi").groupBy("source").agg(
        F.count("*").alias("strict"), F.count_if(F.col("suffix_key") != "").alias("_within")
    )
    left = ours.where(F.col("suffix_key") != "").groupBy("suffix_key").agg(F.count("*").alias("_left"))
    right = theirs.where(F.col("suffix_key") != "").groupBy("source", "suffix_key").agg(
        F.count("*").alias("_right")
    )
    grouped = right.join(left, "suffix_key").groupBy("source").agg(
        F.sum(F.col("_left") * F.col("_right")).alias("_all")
    )
    sources = public.select("source").distinct()
    joined = sources.join(grouped, "source", "left").join(strict, "source", "left").fillna(0)
    tiers = F.create_map(
        F.lit(STRICT), F.col("strict"), F.lit(SUFFIX), F.col("_all") - F.col("_within")
    )
    return joined.select(
        F.col("source").alias("public_record_source"), F.explode(tiers).alias("evidence_tier", "pairs")
    )


def candidate_pairs(campaign: DataFrame, public: DataFrame, limit: int) -> DataFrame:
    """The pairs of two name tables that can appear in a selection of ``limit``.

    Two equality joins instead of one join on "either key": the pairs of equal strict keys, and the
    pairs of equal suffix keys whose strict keys differ. They are disjoint, so nothing is deduplicated.
    """
    # Each side feeds both joins, so its entities are aggregated once and written out.
    left = stage(_campaign_side(campaign), "campaign-entities")
    right = stage(_public_side(public), "public-entities")
    pairs = strict_pairs(left, right, limit).unionByName(suffix_pairs(left, right, limit))
    identity = candidate_id(
        F.col("strict_campaign_key"),
        F.col("strict_public_key"),
        F.col("public_record_source"),
        F.col("public_record_code"),
    )
    return pairs.withColumn("candidate_id", identity)


def _source_lookup(pairs: DataFrame, public: Sequence[Source], value) -> Column:
    out = F.lit("")
    for source in public:
        out = F.when(F.col("public_record_source") == source.contract.slug, value(source)).otherwise(out)
    return out


def _keys_for_suffix(names: DataFrame, selected: DataFrame, name: str) -> DataFrame:
    wanted = selected.select(F.col("suffix_candidate_key").alias("suffix_key")).distinct()
    keys = names.join(wanted, "suffix_key", "left_semi").where(F.col("suffix_key") != "")
    return keys.groupBy(F.col("suffix_key").alias("suffix_candidate_key")).agg(
        F.count_distinct("strict_key").alias(name)
    )


def _decorate(
    selected: DataFrame, campaign: Source, public: Sequence[Source], left: DataFrame, right: DataFrame
) -> DataFrame:
    """Names, links and ambiguity counts of the chosen pairs only.

    ``selected`` is a written table of at most ``limit`` rows; Spark broadcasts it if its files are small.
    """
    chosen_left = selected.select(F.col("strict_campaign_key").alias("strict_key")).distinct()
    chosen_right = selected.select(
        F.col("public_record_source").alias("source"),
        F.col("strict_public_key").alias("strict_key"),
        F.col("public_record_code").alias("code"),
    ).distinct()
    left_names = name_lists(left.join(chosen_left, "strict_key", "left_semi")).select(
        F.col("strict_key").alias("strict_campaign_key"), F.col("names").alias("_campaign_names")
    )
    right_names = name_lists(
        right.join(chosen_right, ["source", "strict_key", "code"], "left_semi")
    ).select(
        F.col("source").alias("public_record_source"),
        F.col("strict_key").alias("strict_public_key"),
        F.col("code").alias("public_record_code"),
        F.col("names").alias("_public_names"),
    )
    out = (
        selected.join(left_names, "strict_campaign_key")
        .join(right_names, ["public_record_source", "strict_public_key", "public_record_code"])
        .join(_keys_for_suffix(left, selected, "campaign_keys_for_suffix"), "suffix_candidate_key", "left")
        .join(_keys_for_suffix(right, selected, "public_keys_for_suffix"), "suffix_candidate_key", "left")
    )

    def public_url(source: Source) -> Column:
        contract = source.contract
        filters = [(contract.name_field, F.col("_public_names"))]
        if contract.code_field:
            filters.append((contract.code_field, F.array("public_record_code")))
        return source_rows_url(contract.portal, contract.dataset_id, contract.public_fields, filters)

    contract = campaign.contract
    types = F.array(*[F.lit(v) for v in contract.type_values])
    campaign_url = source_rows_url(
        contract.portal,
        contract.dataset_id,
        contract.public_fields,
        [(contract.name_field, F.col("_campaign_names")), (contract.type_field, types)],
    )
    amount_field = _source_lookup(out, public, lambda s: F.lit(s.contract.candidate_amount or ""))
    return out.select(
        "position",
        *[c for c in selected.columns if c not in ("position", "public_record_amount")],
        F.array_join("_campaign_names", NAME_SEPARATOR).alias("campaign_names_aggregated"),
        F.array_join("_public_names", NAME_SEPARATOR).alias("public_record_names_aggregated"),
        F.lit(contract.candidate_amount or "").alias("campaign_amount_field"),
        amount_field.alias("public_record_amount_field"),
        F.when(amount_field != "", F.col("public_record_amount")).alias("public_record_amount"),
        F.lit(campaign.artifact_sha256).alias("campaign_artifact_sha256"),
        _source_lookup(out, public, lambda s: F.lit(s.artifact_sha256))
        .alias("public_record_artifact_sha256"),
        campaign_url.alias("campaign_source_rows_url"),
        _source_lookup(out, public, public_url).alias("public_record_source_rows_url"),
        F.coalesce("campaign_keys_for_suffix", F.lit(0)).alias("campaign_keys_for_suffix"),
        F.coalesce("public_keys_for_suffix", F.lit(0)).alias("public_keys_for_suffix"),
    )


def generate_candidates(
    campaign: Source,
    public: Sequence[Source],
    limit: int = 50,
    names: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Ranked, stratified candidate pairs with all evidence, ``limit`` rows at most.

    ``names`` takes name tables staged earlier. Amounts are decimals, null where the source has no
    candidate amount; ``as_text`` gives the all-text worksheet.
    """
    left, right = names or staged_names(campaign, public)
    require_rows(left, f"{campaign.contract.slug}: no organization rows matched the configured types")
    pairs = candidate_pairs(left, right, limit)
    selected = stage(stratified_limit(pairs, limit, ranking()), "selected")
    decorated = _decorate(selected, campaign, public, left, right)
    blank = [F.lit("UNREVIEWED" if c == "review_status" else "").alias(c) for c in WORKSHEET]
    return decorated.select(*EVIDENCE, *blank, "position").orderBy("position")


def amount_text(amount: Column) -> Column:
    """Shortest plain spelling of a decimal."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def text_columns() -> list[Column]:
    """The worksheet's columns as text, in the published order."""
    columns = []
    for name in (*EVIDENCE, *WORKSHEET):
        cell = F.col(name)
        text = amount_text(cell) if name.endswith("_amount") else cell.cast("string")
        columns.append(F.coalesce(text, F.lit("")).alias(name))
    return columns


def as_text(candidates: DataFrame) -> DataFrame:
    """The candidates as an all-text worksheet in the published column order."""
    return candidates.select(*text_columns())


def with_snapshot_hashes(rows: DataFrame, manifests: DataFrame, source: str, at: str, name: str = "artifact_sha256") -> DataFrame:
    """``rows`` with the hash of the snapshot of their ``source`` that was the newest at the time ``at``, null without one.

    A snapshot is named by its hash; times are the texts of the manifests. Candidates made from several snapshots of a source are
    dated row by row.
    """
    acquired = manifests.where(F.col("operation") == ACQUIRE).select(
        F.col("source_slug").alias(source), F.col("receipt.retrieved_at").alias(at), F.regexp_extract("artifact", r"([^/]*?)(?:\.[^./]*)?$", 1).alias(name)
    )
    return newest_at(rows, acquired, source, at, name)
