import hashlib
import random
from collections import Counter, defaultdict
from decimal import Decimal
from urllib.parse import parse_qs, quote, urlparse

import pytest
from pyspark.sql import functions as F

from recordloom.functions.urls import source_rows_url
from recordloom.operators.checks import GateError
from recordloom.operators.entities import campaign_names, entities, keys_per_suffix, public_names
from recordloom.operators.limits import later_occurrences, stratified_limit, top_per_group
from recordloom.plans import candidates as plan
from recordloom.plans.cards import organization_card
from recordloom.sources.contracts import SourceContract
from recordloom.sources.inventory import INVENTORY
from tests.test_functions import name_words, without_suffixes

CAMPAIGN = INVENTORY.require("campaign-contributions")
CHECKS = INVENTORY.require("echeckbook")
CONTRACTS = INVENTORY.require("contracts")


def campaign_df(spark, rows):
    return spark.createDataFrame(rows, "donor string, donor_type string, contribution_amount string")


def checks_df(spark, rows):
    return spark.createDataFrame(rows, "lgl_nm string, vend_cust_cd string, amount string")


def test_only_explicit_organizations_are_admitted(spark):
    df = campaign_df(
        spark,
        [
            ("Example LLC", " Entity ", "10"),
            ("Example Person", "INDIVIDUAL", "20"),
            ("123 Main Street", "ENTITY", "30"),
            ("  ", "ENTITY", "1"),
            ("***", "ENTITY", "1"),
        ],
    )
    (row,) = entities(campaign_names(df, CAMPAIGN)).collect()
    assert (row["strict_key"], row["rows"], row["amount"]) == ("EXAMPLE LLC", 1, Decimal(10))


def test_type_controls_are_required(spark):
    with pytest.raises(GateError):
        campaign_names(campaign_df(spark, [("a", "b", "1")]), CHECKS)
    empty = campaign_df(spark, [("Example", "INDIVIDUAL", "1")])
    source = plan.Source(empty, CAMPAIGN)
    public = plan.Source(checks_df(spark, [("Example", "V1", "1")]), CHECKS)
    with pytest.raises(GateError):
        plan.generate_candidates(source, [public])


def test_display_name_and_placeholders(spark):
    rows = [("acme co", "V1", "$1.50")] * 2 + [("ACME, Co.", "V1", "2")] * 2 + [("Acme Co", " misc1", "9")]
    names = public_names(checks_df(spark, rows), CHECKS)
    (row,) = entities(names).collect()
    assert row["display_name"] == "acme co" and row["rows"] == 4 and row["amount"] == Decimal(7)


def test_links(spark):
    fields = CAMPAIGN.public_fields
    one = spark.range(1).select(
        source_rows_url(CAMPAIGN.portal, CAMPAIGN.dataset_id, fields, [("donor", F.array(F.lit("O'Brien & Co")))])
    ).first()[0]
    assert "O%27%27Brien%20%26%20Co" in one
    query = parse_qs(urlparse(one).query)
    assert query["$select"] == [",".join(fields)] and query["$limit"] == ["50000"]
    two = spark.range(1).select(
        source_rows_url(
            CAMPAIGN.portal, CAMPAIGN.dataset_id, fields,
            [("donor", F.array(F.lit("b~*"), F.lit("a é"))), ("donor_type", F.array(F.lit("ENTITY")))],
        )
    ).first()[0]
    where = "donor in ('a é', 'b~*') AND donor_type = 'ENTITY'"
    assert f"&%24where={quote(where, safe='')}&" in two
    with pytest.raises(ValueError, match="not public"):
        source_rows_url(CAMPAIGN.portal, CAMPAIGN.dataset_id, fields, [("donor_address", F.array())])


def brute_force(campaign, public, limit):
    """Every pair, ranked and cut in plain Python."""
    left = defaultdict(Counter)
    for name, kind, _ in campaign:
        if kind == "ENTITY" and " ".join(name_words(name)):
            left[" ".join(name_words(name))][name] += 1
    right = defaultdict(Counter)
    for slug, name, code in public:
        if " ".join(name_words(name)) and not code.startswith("MIS"):
            right[(" ".join(name_words(name)), slug, code)][name] += 1

    def display(names):
        return min(names, key=lambda n: (-names[n], n.lower(), n))

    rows = []
    for ckey, cnames in left.items():
        for (pkey, slug, code), pnames in right.items():
            suffix = " ".join(without_suffixes(name_words(pkey)))
            if ckey != pkey and (not suffix or " ".join(without_suffixes(name_words(ckey))) != suffix):
                continue
            order = (
                ckey != pkey, -sum(cnames.values()), -sum(pnames.values()),
                display(cnames).lower(), display(pnames).lower(), ckey, pkey, slug, code,
            )
            rows.append(order)
    rows.sort()
    strict = [r for r in rows if not r[0]]
    other = [r for r in rows if r[0]]
    share = (limit + 1) // 2
    chosen = strict[:share] + other[: limit - share]
    chosen += [r for r in rows if r not in chosen] if len(chosen) < limit else []
    return rows, [r[5:] for r in chosen[:limit]]


def random_case(rng, stems):
    ends = ["", " LLC", " Inc", ", L.L.C.", " Co", " LP", " llc"]
    campaign = [
        (rng.choice(stems) + rng.choice(ends), rng.choice(["ENTITY", "ENTITY", "PERSON"]), "1")
        for _ in range(60)
    ]
    public = [
        (rng.choice(["echeckbook", "contracts"]), rng.choice(stems) + rng.choice(ends), rng.choice(["V1", "V2", "V3", "MIS9"]))
        for _ in range(120)
    ]
    return campaign, public


@pytest.mark.parametrize("seed,limit", [(1, 1), (1, 2), (2, 5), (3, 9), (4, 50), (5, 400), (6, 3), (7, 4)])
def test_limited_candidates_equal_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    # One stem holds most names, so a suffix group is far larger than the limit.
    stems = ["Acme"] * 6 + ["Bolt", "Corp", "Ünï"]
    campaign, public = random_case(rng, stems)
    sources = [
        plan.Source(checks_df(spark, [(n, c, "2") for s, n, c in public if s == "echeckbook"]), CHECKS, "e" * 64),
        plan.Source(
            spark.createDataFrame([(n, c) for s, n, c in public if s == "contracts"], "lgl_nm string, vend_cust_cd string"),
            CONTRACTS,
            "c" * 64,
        ),
    ]
    left = plan.Source(campaign_df(spark, campaign), CAMPAIGN, "a" * 64)
    names = plan.staged_names(left, sources)
    every, wanted = brute_force(campaign, public, limit)
    got = plan.generate_candidates(left, sources, limit, names).collect()
    keys = [
        (r["strict_campaign_key"], r["strict_public_key"], r["public_record_source"], r["public_record_code"])
        for r in got
    ]
    assert keys == wanted
    counts = Counter()
    for row in plan.candidate_counts(*names).collect():
        counts[row["public_record_source"], row["evidence_tier"]] += row["pairs"]
    wanted_counts = Counter((r[7], "B_LEGAL_SUFFIX" if r[0] else "A_STRICT") for r in every)
    assert +counts == wanted_counts
    assert tuple(got[0].asDict())[:-1] == plan.EVIDENCE + plan.WORKSHEET
    for row, key in zip(got, keys):
        assert row["candidate_id"] == hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        suffix = row["suffix_candidate_key"]
        assert row["campaign_keys_for_suffix"] == (
            len({" ".join(name_words(n)) for n, k, _ in campaign if k == "ENTITY" and " ".join(without_suffixes(name_words(n))) == suffix}) if suffix else 0
        )
        spellings = sorted({n for n, k, _ in campaign if k == "ENTITY" and " ".join(name_words(n)) == key[0]})
        assert row["campaign_names_aggregated"] == " | ".join(spellings)
        assert (row["public_record_amount"] is None) == (key[2] == "contracts")
    text = plan.as_text(plan.generate_candidates(left, sources, limit, names))
    assert set(text.dtypes) == {(c, "string") for c in plan.EVIDENCE + plan.WORKSHEET}


def test_keys_per_suffix(spark):
    names = public_names(checks_df(spark, [("A LLC", "1", "1"), ("A LP", "2", "1"), ("LLC", "3", "1")]), CHECKS)
    assert [tuple(r) for r in keys_per_suffix(names).collect()] == [("A", 2)]


def test_limit_must_be_positive(spark):
    with pytest.raises(ValueError):
        stratified_limit(spark.range(1), 0, [])


def test_later_occurrences(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 6}") for i in range(200)], "n long, k string")
    got = {r["n"] for r in later_occurrences(df, "k", "n").collect()}
    seen, want = set(), set()
    for i in range(200):
        key = "hot" if i % 3 else f"k{i % 6}"
        want |= {i} if key in seen else set()
        seen.add(key)
    assert got == want


def test_contract_rules():
    with pytest.raises(ValueError):
        SourceContract("s", "d", "t", {"a": ("restricted", "identity")})
    with pytest.raises(ValueError):
        SourceContract("s", "d", "t", {"a": ()}, candidate_amount="a")
    with pytest.raises(ValueError, match="choose one of"):
        INVENTORY.require("nope")
    assert len(INVENTORY) == 6
    for contract in INVENTORY.values():
        assert contract.public_fields and "address" in contract.restricted_patterns
        assert not any(contract.is_restricted(f) for f in contract.public_fields)


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_top_per_group(spark, threshold):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 6}") for i in range(300)], "n long, k string")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        got = {(r["k"], r["n"], r["rank"]) for r in top_per_group(df, ["k"], [F.desc("n")], 5).collect()}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    want = set()
    for key in ("hot", "k0", "k3"):
        rows = sorted((i for i in range(300) if ("hot" if i % 3 else f"k{i % 6}") == key), reverse=True)[:5]
        want |= {(key, n, r + 1) for r, n in enumerate(rows)}
    assert got == want


def test_missing_code_cells_count_as_blank(spark):
    rows = [("Mill Board", None, "5"), ("Mill Board", "", "7"), ("Mill Board", "  ", "1"), ("Mill Board", "V2", "2")]
    found = {(r["code"], r["rows"], r["amount"]) for r in entities(public_names(checks_df(spark, rows), CHECKS)).collect()}
    assert found == {("", 3, Decimal(13)), ("V2", 1, Decimal(2))}
    source = plan.Source(checks_df(spark, rows), CHECKS)
    campaign = plan.Source(campaign_df(spark, [("Mill Board", "ENTITY", "9")]), CAMPAIGN)
    card = {r["side"]: r["rows"] for r in organization_card(campaign, source, ["Mill Board"], ["Mill Board"], "").collect()}
    assert card == {"campaign": 1, "public": 3}


@pytest.mark.parametrize("keep", [999, 1000, 1001])
def test_top_per_group_around_the_threshold(spark, keep):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("n"))
    got = {(r["k"], r["n"], r["rank"]) for r in top_per_group(df, ["k"], [F.desc("n")], keep).collect()}
    assert got == {(k, 2999 - (1 - k) - 2 * i, i + 1) for k in (0, 1) for i in range(keep)}
