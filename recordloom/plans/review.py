"""Review worksheets: creation, validation, drift and the aggregate summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.functions.digests import CANDIDATE_ID, SHA256_HEX, row_fingerprint
from recordloom.functions.text import strip
from recordloom.functions.urls import valid_evidence_urls
from recordloom.functions.values import is_aware_timestamp, parse_date
from recordloom.operators.checks import GateError, explode_rules, require_empty, require_rows
from recordloom.operators.limits import STRICT, SUFFIX, later_occurrences
from recordloom.operators.schema import column_order_violations
from recordloom.plans.candidates import EVIDENCE, WORKSHEET
from recordloom.session import stage
from recordloom.sources.inventory import PUBLIC_SOURCES
from recordloom.sources.snapshot import ROW

# Worksheet columns, vocabularies and summary fields of the review format.
REVIEW = (
    "candidate_fingerprint",
    "review_status",
    "same_organization",
    "review_reason",
    "external_evidence_url",
    "review_notes",
    "reviewer",
    "reviewed_at",
)
DECISIONS = ("YES", "NO", "UNCERTAIN")
REASONS = {
    "YES": ("INDEPENDENT_OFFICIAL_IDENTITY", "SHARED_OFFICIAL_IDENTIFIER"),
    "NO": (
        "AMBIGUOUS_ABBREVIATION",
        "CONFLICTING_IDENTIFIERS",
        "DISTINCT_LEGAL_ENTITIES",
        "FRANCHISE_OR_CHAPTER",
        "PARENT_SUBSIDIARY",
        "PERSON_ORGANIZATION_COLLISION",
        "PLACEHOLDER_IDENTIFIER",
    ),
    "UNCERTAIN": ("CONFLICTING_EVIDENCE", "INSUFFICIENT_EVIDENCE", "SOURCE_DATA_AMBIGUITY"),
}
PROVENANCES = ("HUMAN", "AI_ASSISTED")
SUMMARY_VERSION = 1
SUMMARY_FIELDS = (
    "review_summary_version", "review_provenance", "candidate_set_sha256", "complete", "totals",
    "decisions", "review_reasons", "evidence_tiers", "public_record_sources", "reviewed_through",
)
TOTAL_FIELDS = ("candidates", "reviewed", "unreviewed")
GROUP_FIELDS = ("total", "reviewed", "decisions")

# Hexadecimal digits of a key's hash that name its bucket in a set digest: 65,536 buckets.
_BUCKET_DIGITS = 4


def _check_candidate_columns(columns: list[str]) -> None:
    evidence = [c for c in columns if c not in (*WORKSHEET, ROW)]
    if tuple(evidence) != EVIDENCE:
        raise GateError("candidate columns do not match the current candidate schema")


def check_review_columns(columns: list[str]) -> None:
    if tuple(c for c in columns if c != ROW) != (*EVIDENCE, *REVIEW):
        raise GateError("review columns do not match the current schema")


def review_column_violations(observed: DataFrame, by: str = "source") -> DataFrame:
    """(source, column, rule) for worksheets (source, position, column) whose columns are not the current schema's."""
    return column_order_violations(observed.where(F.col("column") != ROW), (*EVIDENCE, *REVIEW), by)


def id_violations(df: DataFrame, row: str = ROW, laid_out: bool = False) -> DataFrame:
    """(row_number, rule_position, rule): malformed ids, and well-formed ids seen before.

    With ``laid_out`` the table lies by its ids (``sources.layout``): equal ids are neighbours in their task already,
    so they are compared there; otherwise first occurrences are joined back with salts.
    """
    keyed = df.select(F.col(row).alias(ROW), "candidate_id")
    if not laid_out:
        keyed = keyed.fillna("", "candidate_id")
    shape = keyed.where(~F.coalesce(F.col("candidate_id").rlike(CANDIDATE_ID), F.lit(False))).select(
        ROW, F.lit(0).alias("rule_position"), F.lit("candidate_id_shape").alias("rule")
    )
    well_formed = keyed.where(F.col("candidate_id").rlike(CANDIDATE_ID))
    if laid_out:
        nth = F.row_number().over(W.partitionBy("candidate_id").orderBy(ROW))
        later = well_formed.withColumn("_nth", nth).where("_nth > 1")
    else:
        later = later_occurrences(well_formed, "candidate_id", ROW)
    repeated = later.select(
        ROW, F.lit(1).alias("rule_position"), F.lit("duplicate_candidate_id").alias("rule")
    )
    return shape.unionByName(repeated)


def init_review(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Worksheet rows with fingerprints and blank decisions; ids already under review are left out.

    A review that lies by its ids (``sources.layout``) stays where it is; only the candidates are dealt out.
    """
    _check_candidate_columns(candidates.columns)
    rows = candidates
    if existing is not None:
        rows = rows.join(existing.select("candidate_id").distinct(), "candidate_id", "left_anti")
    blank = [
        F.lit("UNREVIEWED" if c == "review_status" else "").alias(c)
        for c in REVIEW
        if c != "candidate_fingerprint"
    ]
    return rows.select(*EVIDENCE, row_fingerprint(EVIDENCE).alias("candidate_fingerprint"), *blank)


def start_review(candidates: DataFrame, out: str, row: str = ROW) -> DataFrame:
    """Write a new worksheet. An existing one is never overwritten."""
    require_rows(candidates, "no candidate rows")
    if row in candidates.columns:
        require_empty(id_violations(candidates, row), "candidate ids")
    init_review(candidates).write.mode("errorifexists").parquet(out)
    return candidates.sparkSession.read.parquet(out)


def review_status(status: Column) -> Column:
    """UNREVIEWED, COMPLETE or INVALID."""
    trimmed = strip(status)
    return F.when(trimmed.isin("UNREVIEWED", "COMPLETE"), trimmed).otherwise("INVALID")


def _reason_allowed(decision: Column, reason: Column) -> Column:
    allowed = F.lit(False)
    for name, reasons in REASONS.items():
        allowed = allowed | ((decision == name) & reason.isin(*reasons))
    return allowed


def review_rules() -> list[tuple[str, Column]]:
    """Row rules after the two id rules, in reporting order, over stripped review cells."""
    entries = [F.col(c) for c in REVIEW[2:]]
    filled = F.concat(*entries) != ""
    status, complete = F.col("review_status"), F.col("review_status") == "COMPLETE"
    decision, known = F.col("same_organization"), F.col("same_organization").isin(*DECISIONS)
    reason, evidence = F.col("review_reason"), F.col("external_evidence_url")
    return [
        ("evidence_changed", F.col("candidate_fingerprint") != F.col("_expected")),
        ("partial_decision", (status == "UNREVIEWED") & filled),
        ("review_status", ~status.isin("UNREVIEWED", "COMPLETE")),
        ("same_organization", complete & ~known),
        ("review_reason", complete & known & ~_reason_allowed(decision, reason)),
        ("external_evidence_url", complete & ~((evidence != "") & valid_evidence_urls(evidence))),
        ("review_notes", complete & (F.col("review_notes") == "")),
        ("reviewer", complete & (F.col("reviewer") == "")),
        ("reviewed_at", complete & ~is_aware_timestamp(F.col("reviewed_at"))),
    ]


def review_violations(review: DataFrame, row: str = ROW) -> DataFrame:
    """(row_number, rule_position, rule) for every broken rule of every row."""
    keyed = review.withColumnRenamed(row, ROW) if row != ROW else review
    filled = {c: F.coalesce(c, F.lit("")) for c in REVIEW}
    cells = keyed.select(
        ROW,
        row_fingerprint(EVIDENCE).alias("_expected"),
        *[(v if c == "candidate_fingerprint" else strip(v)).alias(c) for c, v in filled.items()],
    )
    rules = explode_rules(cells, review_rules(), [ROW])
    shifted = rules.withColumn("rule_position", F.col("rule_position") + 2)
    return id_violations(keyed).unionByName(shifted)


def candidate_drift(candidates: DataFrame, review: DataFrame, row: str = ROW) -> DataFrame:
    """(candidate_id, drift): missing from the review, added to it, or changed since.

    A review that lies by its ids stays where it is here, too.
    """
    current = candidates.select("candidate_id", row_fingerprint(EVIDENCE).alias("_current"))
    return fingerprint_drift(current, review, "candidate_id", "candidate_fingerprint", row)


def fingerprint_drift(
    current: DataFrame, reviewed: DataFrame, key: str, fingerprint: str, row: str
) -> DataFrame:
    """Full outer comparison of (key, _current) with the last fingerprint reviewed per key."""
    last = reviewed.groupBy(key).agg(F.max_by(fingerprint, row).alias("_reviewed"))
    joined = current.join(last, key, "full_outer")
    drift = (
        F.when(F.col("_reviewed").isNull(), "missing")
        .when(F.col("_current").isNull(), "added")
        .when(F.col("_current") != F.col("_reviewed"), "changed")
    )
    return joined.select(key, drift.alias("drift")).where(F.col("drift").isNotNull())


def drift_counts(drift: DataFrame) -> DataFrame:
    return drift.groupBy("drift").agg(F.count("*").alias("candidates"))


def _complete() -> Column:
    return review_status(F.coalesce("review_status", F.lit(""))) == "COMPLETE"


def review_totals(review: DataFrame) -> DataFrame:
    """(candidates, reviewed, unreviewed, complete); reviewed counts distinct ids."""
    totals = review.groupBy().agg(
        F.count("*").alias("candidates"),
        F.count_distinct(F.when(_complete(), F.col("candidate_id"))).alias("reviewed"),
    )
    return totals.select(
        "candidates",
        "reviewed",
        (F.col("candidates") - F.col("reviewed")).alias("unreviewed"),
        (F.col("candidates") == F.col("reviewed")).alias("complete"),
    )


def decision_counts(review: DataFrame) -> DataFrame:
    """One zero-filled column per decision."""
    decision = strip(F.coalesce("same_organization", F.lit("")))
    return review.groupBy().agg(
        *[F.count_if(_complete() & (decision == d)).alias(d) for d in DECISIONS]
    )


def reason_counts(review: DataFrame) -> DataFrame:
    reason = strip(F.coalesce("review_reason", F.lit(""))).alias("review_reason")
    return review.where(_complete()).groupBy(reason).agg(F.count("*").alias("rows"))


def group_report(review: DataFrame) -> DataFrame:
    """(dimension, group, total, reviewed, YES, NO, UNCERTAIN) by tier and by source, in one pass.

    Decisions are compared without padding, like the overall counts.
    """
    decision = strip(F.coalesce("same_organization", F.lit("")))
    marked = review.select(
        "evidence_tier", "public_record_source", _complete().alias("done"), decision.alias("decision")
    )
    grouped = marked.groupingSets(
        [["evidence_tier"], ["public_record_source"]], "evidence_tier", "public_record_source"
    ).agg(
        F.grouping("evidence_tier").alias("g"),
        F.count("*").alias("total"),
        F.count_if("done").alias("reviewed"),
        *[F.count_if(F.col("done") & (F.col("decision") == d)).alias(d) for d in DECISIONS],
    )
    return grouped.select(
        F.when(F.col("g") == 0, "evidence_tiers").otherwise("public_record_sources").alias("dimension"),
        F.when(F.col("g") == 0, F.col("evidence_tier"))
        .otherwise(F.col("public_record_source")).alias("group"),
        "total", "reviewed", *DECISIONS,
    )


def _digest(label: str, value: str) -> Column:
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("a"), F.col(value).alias("b")))),
        lambda line: F.concat_ws(":", line["a"], line["b"]),
    )
    return F.sha2(F.array_join(lines, "\n"), 256)


def set_digest(df: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """One row, ``set_sha256``: a SHA-256 over the set of ``key:fingerprint`` lines, in two levels.

    A digest over one long text cannot be split. So the lines are dealt to 65,536 buckets by the first digits of
    their key's SHA-256, whatever the keys look like; a bucket's digest covers its lines in key order, and the result
    covers the ``bucket:digest`` lines in order. The definition is the same at every size. A repeated line, which a
    valid review does not have, counts once. No lines give the digest of the empty text.
    """
    lines = df.select(key, fingerprint).distinct()
    bucket = F.substring(F.sha2(F.col(key), 256), 1, _BUCKET_DIGITS)
    buckets = lines.groupBy(bucket.alias("bucket")).agg(_digest(key, fingerprint).alias("digest"))
    return buckets.groupBy().agg(_digest("bucket", "digest").alias("set_sha256"))


def reviewed_through(review: DataFrame) -> DataFrame:
    """Greatest ``reviewed_at`` as text, and the latest instant."""
    at = F.when(_complete(), F.col("reviewed_at"))
    return review.groupBy().agg(
        F.max(at).alias("reviewed_through"), F.max(parse_date(strip(at))).alias("latest_review")
    )


_SUMMARIZED = (
    "candidate_id", "candidate_fingerprint", "evidence_tier", "public_record_source", "review_status",
    "same_organization", "review_reason", "reviewed_at",
)


def _as_map(names, value) -> Column:
    return F.create_map(*[x for name in names for x in (F.lit(name), value(name))])


def review_summary(review: DataFrame, provenance: str) -> DataFrame:
    """The aggregate report as one nested row. It holds counts and digests only.

    A narrow copy of the review is written and read three times: for the overall counts, the groups and the digest.
    Reasons and groups are those of the vocabularies, so the row is bounded even for an invalid review.
    """
    if provenance not in PROVENANCES:
        raise GateError(f"review provenance must be one of: {', '.join(PROVENANCES)}")
    narrow = stage(review.select(*_SUMMARIZED), "summarized")
    decision = strip(F.coalesce("same_organization", F.lit("")))
    reason = strip(F.coalesce("review_reason", F.lit("")))
    reasons = [r for listed in REASONS.values() for r in listed]
    totals = narrow.groupBy().agg(
        F.count("*").alias("candidates"),
        F.count_distinct(F.when(_complete(), F.col("candidate_id"))).alias("reviewed"),
        F.max(F.when(_complete(), F.col("reviewed_at"))).alias("reviewed_through"),
        *[F.count_if(_complete() & (decision == d)).alias(f"decision_{d}") for d in DECISIONS],
        *[F.count_if(_complete() & (reason == r)).alias(f"reason_{r}") for r in dict.fromkeys(reasons)],
    )
    counts = F.struct("total", "reviewed", _as_map(DECISIONS, F.col).alias("decisions"))
    entry = F.struct(F.col("group"), counts.alias("report"))
    known = {"evidence_tiers": (STRICT, SUFFIX), "public_record_sources": PUBLIC_SOURCES}
    groups = group_report(narrow).groupBy().agg(
        *[
            F.map_from_entries(
                F.collect_list(F.when((F.col("dimension") == name) & F.col("group").isin(*allowed), entry))
            ).alias(name)
            for name, allowed in known.items()
        ]
    )
    gathered = totals.select(
        "*",
        set_digest(narrow, "candidate_id", "candidate_fingerprint").scalar().alias("digest"),
        groups.select(F.struct(*known)).scalar().alias("groups"),
    )
    given = F.map_filter(_as_map(dict.fromkeys(reasons), lambda r: F.col(f"reason_{r}")), lambda _, n: n > 0)
    unreviewed = F.col("candidates") - F.col("reviewed")
    return gathered.select(
        F.lit(SUMMARY_VERSION).cast("bigint").alias("review_summary_version"),
        F.lit(provenance).alias("review_provenance"),
        F.col("digest").alias("candidate_set_sha256"),
        (unreviewed == 0).alias("complete"),
        F.struct("candidates", "reviewed", unreviewed.alias("unreviewed")).alias("totals"),
        _as_map(DECISIONS, lambda d: F.col(f"decision_{d}")).alias("decisions"),
        given.alias("review_reasons"),
        *[F.col(f"groups.{name}").alias(name) for name in known],
        "reviewed_through",
    )


def publish_summary(
    review: DataFrame, candidates: DataFrame, provenance: str, row: str = ROW
) -> DataFrame:
    """The summary of a clean, complete review that still matches its candidates; refuses any other."""
    check_review_columns(review.columns)
    require_rows(review, "no review rows")
    require_empty(review_violations(review, row), "review rows")
    require_empty(candidate_drift(candidates, review, row), "candidate drift")
    require_empty(review.where(~_complete()), "review is incomplete")
    return review_summary(review, provenance)


_MAP = "map<string,string>"
# The document three times: with every value as text, for names and texts; with typed counts and flags, which read
# quoted numbers, fractions and quoted booleans as null; and with every group as a flat map, which tells its fields.
_COUNTS = "map<string,bigint>"
_TOTALS = ", ".join(f"{name}: bigint" for name in TOTAL_FIELDS)
_TYPED_GROUP = f"struct<total:bigint,reviewed:bigint,decisions:{_COUNTS}>"
_TYPED = (
    f"review_summary_version bigint, complete boolean, totals struct<{_TOTALS}>, decisions {_COUNTS}, review_reasons {_COUNTS}, "
    f"evidence_tiers map<string,{_TYPED_GROUP}>, public_record_sources map<string,{_TYPED_GROUP}>"
)
_VALUES = (
    "review_summary_version string, review_provenance string, candidate_set_sha256 string, "
    f"totals {_MAP}, decisions {_MAP}, review_reasons {_MAP}, reviewed_through string"
)
_KEYS = f"evidence_tiers map<string,{_MAP}>, public_record_sources map<string,{_MAP}>"


def _is_count(value: Column) -> Column:
    return F.coalesce((value >= 0) & (value < 10**18), F.lit(False))


def _counts_ok(values: Column) -> Column:
    """Whole numbers of at most 18 digits, none of them missing; false if there is no such object."""
    return F.coalesce(F.forall(F.map_values(values), _is_count), F.lit(False))


def _count_sum(values: Column) -> Column:
    return F.aggregate(F.map_values(values), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v, F.lit(0)))


def _has_keys(found: Column, keys: tuple[str, ...]) -> Column:
    wanted = F.array(*[F.lit(k) for k in sorted(keys)])
    return F.coalesce(F.array_sort(F.map_keys(found)) == wanted, F.lit(False))


def _group_ok(group: Column, keys: Column) -> Column:
    """One group: its exact fields, and counts that agree. ``keys`` is the same object as a flat map."""
    total, reviewed, decisions = group["total"], group["reviewed"], group["decisions"]
    return F.coalesce(
        _has_keys(keys, GROUP_FIELDS) & _has_keys(decisions, DECISIONS)
        & _is_count(total) & _is_count(reviewed) & _counts_ok(decisions)
        & (total >= 1) & (reviewed == total) & (_count_sum(decisions) == total),
        F.lit(False),
    )


def _group_rules(
    groups: Column, keys: Column, allowed: tuple[str, ...], expected: Column, name: str
) -> list[tuple[str, Column]]:
    known = F.forall(F.map_keys(keys), lambda k: k.isin(*allowed))
    counted = F.forall(F.map_entries(keys), lambda e: _group_ok(F.element_at(groups, e["key"]), e["value"]))
    totals = F.aggregate(
        F.map_values(groups), F.lit(0).cast("bigint"), lambda a, group: a + F.coalesce(group["total"], F.lit(0))
    )
    return [
        (f"{name}_groups", F.coalesce((F.size(keys) < 1) | ~known, F.lit(True))),
        (f"{name}_counts", ~F.coalesce(counted, F.lit(False))),
        (f"{name}_total", F.coalesce(totals != expected, F.lit(True))),
    ]


def summary_violations(summaries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule_position, rule) over a table of summary documents held as JSON text."""
    parsed = summaries.select(
        key,
        F.array_sort(F.json_object_keys(text)).alias("fields"),
        F.from_json(text, _VALUES).alias("s"),
        F.from_json(text, _TYPED).alias("t"),
        F.from_json(text, _KEYS).alias("k"),
    )
    texts = ("review_provenance", "candidate_set_sha256", "totals", "decisions", "review_reasons", "reviewed_through")
    s = {name: F.col(f"s.{name}") for name in texts}
    t = {name: F.col(f"t.{name}") for name in ("totals", "decisions", "review_reasons", "evidence_tiers", "public_record_sources")}
    totals = {n: F.when(_is_count(t["totals"][n]), t["totals"][n]) for n in TOTAL_FIELDS}
    reviewed = totals["reviewed"]
    every_reason = [reason for reasons in REASONS.values() for reason in reasons]
    reasons = s["review_reasons"]

    def unless(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    rules = [
        ("fields", unless(F.col("fields") == F.array(*[F.lit(f) for f in sorted(SUMMARY_FIELDS)]))),
        ("version", unless(F.col("t.review_summary_version") == SUMMARY_VERSION)),
        ("provenance", unless(s["review_provenance"].isin(*PROVENANCES))),
        ("digest", unless(s["candidate_set_sha256"].rlike(SHA256_HEX))),
        ("complete", unless(F.col("t.complete"))),
        ("total_fields", ~_has_keys(s["totals"], TOTAL_FIELDS)),
        (
            "totals",
            unless((totals["candidates"] >= 1) & (reviewed == totals["candidates"]) & (totals["unreviewed"] == 0)),
        ),
        ("decision_fields", ~_has_keys(s["decisions"], DECISIONS)),
        ("decisions", unless(_counts_ok(t["decisions"]) & (_count_sum(t["decisions"]) == reviewed))),
        (
            "known_reasons",
            unless((F.size(reasons) > 0) & F.forall(F.map_keys(reasons), lambda k: k.isin(*every_reason))),
        ),
        (
            "reasons",
            unless(
                _counts_ok(t["review_reasons"])
                & F.forall(F.map_values(t["review_reasons"]), lambda v: F.coalesce(v >= 1, F.lit(False)))
                & (_count_sum(t["review_reasons"]) == reviewed)
            ),
        ),
        *_group_rules(
            t["evidence_tiers"], F.col("k.evidence_tiers"), (STRICT, SUFFIX), reviewed, "evidence_tiers"
        ),
        *_group_rules(
            t["public_record_sources"], F.col("k.public_record_sources"), PUBLIC_SOURCES, reviewed,
            "public_record_sources",
        ),
        ("reviewed_through", unless(is_aware_timestamp(s["reviewed_through"]))),
    ]
    return explode_rules(parsed, rules, [key])
