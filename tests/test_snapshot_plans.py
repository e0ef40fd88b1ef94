import hashlib
import json

import pytest

from recordloom.operators.checks import GateError
from recordloom.plans import review, snapshots
from recordloom.plans.candidates import EVIDENCE
from recordloom.sources import manifests as M
from recordloom.sources.contracts import ContractError, SourceContract
from recordloom.sources.inventory import INVENTORY
from tests.test_review import pairs
from workload.queries import QUERIES

CONTRIBUTIONS = INVENTORY.require("campaign-contributions")
CONTRACTS = INVENTORY.require("contracts")


def store(root, docs, operation, folder, suffix, content, at):
    digest = hashlib.sha256(content).hexdigest()
    artifact = f"data/{folder}/{CONTRIBUTIONS.dataset_id}/{digest}{suffix}"
    (root / artifact).parent.mkdir(parents=True, exist_ok=True)
    (root / artifact).write_bytes(content)
    payload = {
        "manifest_version": 1, "operation": operation, "source_slug": CONTRIBUTIONS.slug,
        "dataset_id": CONTRIBUTIONS.dataset_id, "artifact": artifact,
        "receipt": {"sha256": digest, "bytes": len(content), "retrieved_at": at},
    }
    docs.mkdir(exist_ok=True)
    (docs / f"{digest}.json").write_text(json.dumps(payload))
    return digest


def test_latest_snapshot_is_landed_under_api_names(spark, tmp_path):
    root, docs = tmp_path / "root", tmp_path / "docs"
    metadata = {
        "id": CONTRIBUTIONS.dataset_id,
        "columns": [
            {"name": "Donor", "fieldName": "donor"},
            {"name": "Donor_Type", "fieldName": "donor_type"},
            {"name": "Amount Given", "fieldName": "contribution_amount"},
        ],
    }
    store(root, docs, M.FREEZE, "metadata", ".json", json.dumps(metadata).encode(), "2026-08-17T00:00:00+00:00")
    store(root, docs, M.ACQUIRE, "raw", ".csv", b"Donor,Donor_Type,Amount Given\nOld,ENTITY,1\n", "2026-08-17T00:00:00+00:00")
    newest = store(root, docs, M.ACQUIRE, "raw", ".csv", b"Donor,Donor_Type,Amount Given\nNew,ENTITY,1\n", "2026-08-18T00:00:00+00:00")
    manifests = M.read_manifests(spark, str(docs))
    source = snapshots.land_latest(spark, str(root), CONTRIBUTIONS, manifests, str(tmp_path / "landed"))
    (row,) = source.df.select("donor", "donor_type", "contribution_amount", "row_number").collect()
    assert tuple(row) == ("New", "ENTITY", "1", 2) and source.artifact_sha256 == newest
    with pytest.raises(GateError, match="no acquire-csv manifest"):
        snapshots.latest_path(manifests, CONTRACTS, M.ACQUIRE)
    with pytest.raises(GateError, match="another dataset"):
        snapshots.source_column_map(spark, str(root / snapshots.latest_path(manifests, CONTRIBUTIONS, M.FREEZE)), CONTRACTS)


WELLS = SourceContract(
    "wells", "wells-1", "Wells",
    {"well_no": ("identity",), "remarks": (), "depth": ("amount",), "owner_phone": ("restricted",), "surveyed_on": ("date",)},
)


def test_public_file_check(spark, tmp_path):
    path = tmp_path / "wells.csv"

    def found():
        return sorted(tuple(r)[:4] for r in snapshots.check_public_file(spark, str(path), WELLS).collect())

    path.write_text('Well No,Remarks,Depth\n1,dry,12\n2,"mail ida@mill.example\nor ring 206 555 0143",9\n3,,\n4,12 Mill Road,3\n')
    assert found() == [
        (3, "remarks", "email", "[redacted]"), (3, "remarks", "phone", "[redacted]"), (5, "remarks", "street_address", "[redacted]"),
    ]
    # A record with a cell too many, behind one with a line break, stops the check; a short one does not.
    path.write_text('Well No,Remarks\n1,"two\nlines"\n2\n3,ok,ring 206 555 0143\n')
    with pytest.raises(GateError, match="do not fit the header: 1 violation"):
        found()
    path.write_text("Well No,Remarks\n1\n2,ok\n")
    assert found() == []
    for column, rule in (("Owner Phone", "not allowlisted"), ("Colour", "not allowlisted")):
        path.write_text(f"Well No,{column}\n1,\n2,\n")
        with pytest.raises(ContractError, match=rule):
            found()


def test_private_file_audit(spark, tmp_path):
    path = tmp_path / "private.csv"
    lines = [f"{i},depth by hand,{i},+1 206 555 01{i:02d},2020-01-{i:02d}" for i in range(1, 20)]
    lines[10] = "11,ask at 4 Harbour Lane,11,206 555 0111,2020-01-11"
    path.write_text("\n".join(["Well No,Remarks,Depth,Owner Phone,Surveyed On", *lines]) + "\n")
    found = snapshots.audit_private_file(spark, str(path), WELLS).collect()
    assert [tuple(r)[:3] for r in found] == [(12, "remarks", "street_address")]  # the phones lie in a column that stays unread
    path.write_text("Well No,Remarks\n1,x\n")
    with pytest.raises(ContractError):
        snapshots.audit_private_file(spark, str(path), WELLS)


def test_worksheet_round_trip(spark, tmp_path):
    made = review.init_review(pairs(spark, 2).drop("row_number"))
    folder = str(tmp_path / "sheet")
    made.coalesce(1).write.csv(folder, header=True, escape='"', emptyValue="")
    sheet = snapshots.read_worksheet(spark, folder)
    assert sheet.count() == 2 and review.review_violations(sheet).count() == 0
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join((*EVIDENCE, *review.REVIEW)) + "\nshort,row\n")
    with pytest.raises(GateError, match="do not fit"):
        snapshots.read_worksheet(spark, str(bad))


def test_frozen_metadata_of_every_order(spark, sf_dir):
    """Every order with a broken document or manifest is reported, whoever its customer is."""
    orders = {str(r.o_orderkey): r for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    for name, key in (("frozen_metadata_violations", "o_orderkey"), ("frozen_metadata_violations_all", "o_custkey")):
        found = QUERIES[name](spark, sf_dir).select("manifest").distinct().collect()
        want = {k for k, r in orders.items() if r.o_orderkey % 5 == 0 or r[key] % 7 == 0 or r[key] % 13 == 0}
        assert {r.manifest for r in found} == want
