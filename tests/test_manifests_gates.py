import hashlib
import json
import os

from recordloom.plans import audit, cards, gates
from recordloom.plans import candidates as plan
from recordloom.sources import manifests as M
from recordloom.sources import sinks
from recordloom.sources.contracts import contract_sources
from recordloom.sources.inventory import INVENTORY
from tests.test_candidates import CAMPAIGN, CHECKS, campaign_df, checks_df


def manifest(folder, name, content=b"a,b\n1,2\n", **change):
    digest = hashlib.sha256(content).hexdigest()
    payload = {
        "manifest_version": 1, "operation": "acquire-csv", "source_slug": "contracts", "dataset_id": "84ih-p28j",
        "artifact": f"data/raw/84ih-p28j/{digest}.csv",
        "receipt": {"sha256": digest, "bytes": len(content), "retrieved_at": "2026-08-18T00:00:00+00:00",
                    "response_headers": {"etag": "x"}},
    }
    payload.update(change)
    (folder / name).write_text(json.dumps(payload, indent=1))
    return payload


def test_manifests_and_latest(spark, tmp_path):
    first = manifest(tmp_path, "a.json")
    later = dict(first["receipt"], retrieved_at="2026-08-19T00:00:00+00:00")
    manifest(tmp_path, "b.json", artifact="data/raw/84ih-p28j/new.csv", receipt=later)
    read = M.read_manifests(spark, str(tmp_path))
    assert read.select("receipt.response_headers").first()[0] == {"etag": "x"}
    (row,) = M.latest_artifacts(read).collect()
    assert row["artifact"].endswith("new.csv")
    rows = spark.createDataFrame(
        [("contracts", "2026-08-18T12:00:00+00:00"), ("contracts", "2026-08-19T00:00:00+00:00"), ("contracts", "2026-08-01"), ("other", "2027"), (None, "2027"), ("contracts", None)],
        "source string, at string",
    )
    got = [r["artifact_sha256"] for r in plan.with_snapshot_hashes(rows, read, "source", "at").orderBy("source", "at").collect()]
    assert got == [None, None, None, first["receipt"]["sha256"], "new", None]


def test_verification(spark, tmp_path):
    docs, data = tmp_path / "docs", tmp_path / "root"
    docs.mkdir()
    (data / "data/raw/84ih-p28j").mkdir(parents=True)
    good = manifest(docs, "good.json")
    bad = manifest(docs, "bad.json", b"x,y\nchanged\n")
    manifest(docs, "gone.json", b"p,q\n")
    (data / good["artifact"]).write_bytes(b"a,b\n1,2\n")
    (data / bad["artifact"]).write_bytes(b"x,y\nmutated\n")
    found = M.verify_artifacts(spark, M.read_manifests(spark, str(docs)), str(data)).collect()
    assert {(r["manifest"], r["rule"]) for r in found} == {("bad.json", "integrity_mismatch"), ("gone.json", "missing")}


def test_registration_is_content_addressed(spark, tmp_path):
    landing, root = tmp_path / "landing", tmp_path / "root"
    (landing / "contracts").mkdir(parents=True)
    for name, content in (("a.csv", b"a,b\n1,2\n"), ("b.csv", b"a,b\n1,2\n"), ("c.csv", b"nothing"), ("d.csv", b"c,d\n3,4\n")):
        (landing / "contracts" / name).write_bytes(content)
    files = M.list_files(spark, str(landing))
    hashed = M.hash_files(files)
    assert {os.path.basename(r["path"]): r["rule"] for r in M.snapshot_violations(hashed).collect()} == {"c.csv": "no_csv_header"}
    sources = contract_sources(spark, INVENTORY.values())
    registered = M.register_snapshots(hashed.where("header_line"), files, sources)
    assert registered.count() == 3
    none = registered.limit(0)
    fresh = M.new_content(registered, none)
    assert fresh.count() == 2
    stored = {r[0] for r in M.store_content(fresh, str(root)).collect()}
    assert all((root / path).is_file() for path in stored)
    assert M.verify_artifacts(spark, registered, str(root)).count() == 0
    assert M.new_content(registered, registered).count() == 0
    assert gates.manifest_violations(registered, sources).count() == 0


def test_manifest_gate(spark, tmp_path):
    good = manifest(tmp_path, "good.json")
    cases = {
        "v.json": ({"manifest_version": 2}, {"version"}),
        "s.json": ({"source_slug": "nope"}, {"unknown_source", "raw_location"}),
        "d.json": ({"dataset_id": "x"}, {"dataset_id"}),
        "r.json": ({"receipt": None}, {"receipt", "artifact_name"}),
        "h.json": ({"receipt": {**good["receipt"], "sha256": "abc"}}, {"sha256", "artifact_name"}),
        "b.json": ({"receipt": {**good["receipt"], "bytes": 0}}, {"bytes"}),
        "p.json": ({"artifact": f"data/raw/../84ih-p28j/{good['receipt']['sha256']}.csv"}, {"artifact_path", "raw_location"}),
        "o.json": ({"operation": "delete"}, {"operation"}),
        "m.json": ({"operation": "freeze-metadata"}, {"metadata_location"}),
        "e.json": ({"artifact": ""}, {"artifact_path", "artifact_name", "raw_location"}),
    }
    for name, (change, _) in cases.items():
        manifest(tmp_path, name, **change)
    sources = contract_sources(spark, INVENTORY.values())
    found = {}
    for r in gates.manifest_violations(M.read_manifests(spark, str(tmp_path)), sources).collect():
        found.setdefault(r["manifest"], set()).add(r["rule"])
    assert found == {name: rules for name, (_, rules) in cases.items()}


def test_profile_and_coverage_gates(spark, tmp_path):
    made = manifest(tmp_path, "good.json")
    manifests = M.read_manifests(spark, str(tmp_path))
    sources = contract_sources(spark, INVENTORY.values())
    columns = ("profile_file string, profile_version bigint, source string, dataset_id string, artifact string, "
               "row_count bigint, expected_minimum_rows bigint, meets_expected_minimum boolean")
    base = ["p", 1, "contracts", "84ih-p28j", made["artifact"], 600, 500, True]

    def case(name, **change):
        keys = ["profile_file", "profile_version", "source", "dataset_id", "artifact", "row_count",
                "expected_minimum_rows", "meets_expected_minimum"]
        return tuple({**dict(zip(keys, base)), "profile_file": name, **change}[k] for k in keys)

    rows = [
        case("ok"), case("version", profile_version=3), case("dataset_id", dataset_id="x"),
        case("row_floor", expected_minimum_rows=1), case("row_count", row_count=-1, meets_expected_minimum=False),
        case("floor_result", row_count=499), case("artifact_without_manifest", artifact="other"),
    ]
    profiles = spark.createDataFrame(rows, columns)
    found = {r["profile_file"]: r["rule"] for r in gates.profile_violations(profiles, sources, manifests).collect()}
    assert found == {r[0]: r[0] for r in rows[1:]}
    fixtures = spark.createDataFrame([("contracts",)], "source string")
    lacking = gates.coverage_violations(sources, manifests, profiles, fixtures)
    assert lacking.where("source = 'contracts'").collect()[0]["rule"] == "no_metadata"
    assert lacking.count() == 6 + 5 + 5
    summary = {r["artifact_kind"]: r["checked"] for r in gates.gate_summary(manifests, profiles, fixtures, fixtures).collect()}
    assert summary == {"manifests": 1, "metadata_artifacts": 0, "profiles": 7, "fixtures": 1, "review_summaries": 1}
    latest = M.latest_profiles(profiles)
    assert [r["profile_file"] for r in latest.collect()] == ["version"]


def test_audit_card_and_sinks(spark, tmp_path):
    campaign = plan.Source(
        campaign_df(spark, [("Acme LLC", "ENTITY", "10"), ("Acme LLC", "ENTITY", "$5"), ("Bolt", "ENTITY", "1"), ("Zed", "ENTITY", "1")]),
        CAMPAIGN, "a" * 64,
    )
    checks = plan.Source(
        checks_df(spark, [("ACME LLC", "V1", "7"), ("Acme, Inc.", "V2", "1"), ("bolt", "V3", "2"), ("x", "MIS1", "1"), ("", "mis2", "1")]),
        CHECKS, "e" * 64,
    )
    contracts = plan.Source(spark.createDataFrame([], "lgl_nm string, vend_cust_cd string"), INVENTORY.require("contracts"), "c" * 64)
    names = plan.staged_names(campaign, [checks, contracts])
    candidates = plan.generate_candidates(campaign, [checks, contracts], 50, names)
    profile = spark.createDataFrame([("s", "day", 3, ["x"]), ("s", "n", 0, [])], "source string, field string, suspicious_date_count bigint, suspicious_date_examples array<string>")
    result = audit.identity_audit(campaign, [checks, contracts], candidates, profile, names)
    rows = {r["source"]: r.asDict() for r in result.public.collect()}
    assert rows["echeckbook"] == {
        "source": "echeckbook", "invalid_code_prefixes": "MIS", "artifact_sha256": "e" * 64, "eligible_rows": 3,
        "eligible_raw_names": 3, "eligible_codes": 3, "strict_name_keys": 3, "suffix_candidate_keys": 2,
        "exact_strict_key_overlap": 2, "legal_suffix_key_overlap": 2, "invalid_code_rows": 2, "invalid_code_names": 1,
        "invalid_codes": 2,
    }
    assert rows["contracts"]["eligible_rows"] == 0 and rows["contracts"]["invalid_code_rows"] == 0
    (population,) = result.campaign.collect()
    assert (population["rows"], population["strict_name_keys"], population["amount"]) == (4, 3, 17)
    assert result.matched_campaign_keys.first()[0] == 2
    counters = {(r["dimension"], r["value"]): r["candidates"] for r in result.candidates.collect()}
    assert counters[("evidence_tier", "A_STRICT")] == 2 and counters[("all", "campaign_keys")] == 2
    assert counters[("public_record_source", "echeckbook")] == 3 and counters[("all", "reviewed_rows")] == 0
    assert [r["field"] for r in result.suspicious_dates.collect()] == ["day"]
    card = {r["side"]: r for r in cards.organization_card(campaign, checks, ["Acme LLC"], ["ACME LLC"], "V1").collect()}
    assert (card["campaign"]["rows"], card["campaign"]["amount"]) == (2, 15)
    assert (card["public"]["rows"], card["public"]["amount"]) == (1, 7)
    sinks.write_candidates(candidates, str(tmp_path / "c"), csv=True)
    assert sinks.output_rows(spark, str(tmp_path / "c"), "csv").first()[0] == 3
    sinks.write_candidates(candidates, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == [*plan.EVIDENCE, *plan.WORKSHEET]
    for run in ("r1", "r2", "r2"):
        sinks.write_profile(profile, str(tmp_path / "profile"), run)
    assert spark.read.parquet(str(tmp_path / "profile")).groupBy("run").count().orderBy("run").collect() == [("r1", 2), ("r2", 2)]
    sinks.write_report(result.public, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    fixture = spark.createDataFrame([(2, "EXAMPLE ORGANIZATION 0001")], "row_number bigint, lgl_nm string")
    sinks.write_fixture(fixture, CHECKS, str(tmp_path / "f"))
    assert sinks.output_rows(spark, str(tmp_path / "f"), "csv").first()[0] == 1


def test_incremental_landing(spark, tmp_path):
    from recordloom.streaming.landing import land_new_files

    landing, root, table = tmp_path / "in", tmp_path / "root", str(tmp_path / "manifests")
    rejects = str(tmp_path / "rejects")
    (landing / "contracts").mkdir(parents=True)
    root.mkdir()
    sources = contract_sources(spark, INVENTORY.values())

    def run():
        land_new_files(spark, str(landing), str(root), table, rejects, sources, str(tmp_path / "checkpoint")).awaitTermination()
        return spark.read.parquet(table)

    (landing / "contracts" / "a.csv").write_bytes(b"a,b\n1,2\n")
    assert run().count() == 1
    (landing / "contracts" / "b.csv").write_bytes(b"a,b\n1,2\n")
    (landing / "contracts" / "c.csv").write_bytes(b"a,b\n3,4\n")
    registered = run()
    assert registered.count() == 3 and registered.select("artifact").distinct().count() == 2
    assert len([p for p in root.rglob("*.csv")]) == 2
    assert M.verify_artifacts(spark, registered, str(root)).count() == 0
    # A header longer than any read buffer is one; whatever cannot be registered is reported, not lost.
    (landing / "elsewhere").mkdir()
    wide = ",".join(f"column_{i:06d}" for i in range(150_000)).encode() + b"\n1\n"
    for name, content in (("contracts/wide.csv", wide), ("contracts/none.csv", b"no header"), ("elsewhere/a.csv", b"a,b\n"), ("contracts/empty.csv", b"")):
        (landing / name).write_bytes(content)
    assert run().count() == 4
    found = {(os.path.basename(r["path"]), r["rule"]) for r in spark.read.parquet(rejects).collect()}
    assert found == {("none.csv", "no_csv_header"), ("a.csv", "unknown_source"), ("empty.csv", "empty")}


def test_metadata_names_its_own_dataset(spark):
    sources = contract_sources(spark, INVENTORY.values())
    metadata = spark.createDataFrame(
        [("contracts", "84ih-p28j"), ("echeckbook", "zzzz-zzzz"), ("purchase-orders", None)], "source string, id string"
    )
    found = {r["source"] for r in M.metadata_violations(metadata, sources).collect()}
    assert found == {"echeckbook", "purchase-orders"}


def test_fixture_scans(spark):
    clean = spark.createDataFrame([(2, "EXAMPLE ORGANIZATION 0001")], "row_number bigint, lgl_nm string")
    leaky = spark.createDataFrame([(2, "call (512) 555-0199")], "row_number bigint, doc_dscr string")
    found = gates.fixture_violations({"echeckbook": clean, "contracts": leaky}, INVENTORY).collect()
    assert [tuple(r) for r in found] == [("contracts", "doc_dscr", "phone", 1)]
