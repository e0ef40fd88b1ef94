"""Outputs that appear at once, joins with the newest entry at a time, first findings and counts in one pass."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import privacy
from recordloom.operators.asof import newest_at
from recordloom.operators.checks import GateError
from recordloom.plans import candidates
from recordloom.sources import publish as P
from recordloom.sources import sinks
from tests.test_review import pairs


def test_a_failed_run_leaves_the_output_as_it_was(spark, tmp_path):
    path = str(tmp_path / "out")
    assert P.published(spark, path) is None
    with pytest.raises(GateError, match="nothing has been published"):
        P.read_published(spark, path)
    even = spark.range(10).where("id % 2 = 0")
    assert P.publish(even, path, "a", {"odd": F.col("id") % 2 == 1}) == 5
    with pytest.raises(GateError, match="'odd': 5"):
        P.publish(spark.range(10), path, "b", {"odd": F.col("id") % 2 == 1})
    broken = spark.range(10).withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise("ok"))
    with pytest.raises(Exception, match="lost"):
        P.publish(broken, path, "c")
    assert P.published(spark, path) == {"run": "a", "format": "parquet", "rows": 5} and P.read_published(spark, path).count() == 5
    for _ in range(2):  # repeated, a run replaces itself
        assert P.publish(spark.range(7), path, "b") == 7
    assert P.read_published(spark, path).count() == 7
    assert not [name for name in os.listdir(path) if name.startswith("_current-")]
    assert P.publish(spark.range(3).where("id > 5"), path, "none") == 0 and P.read_published(spark, path).count() == 0
    assert sinks.output_rows(spark, path).first()[0] == 0


def test_every_pair_has_its_own_id(spark, tmp_path):
    made = pairs(spark, 3).withColumn("position", F.col("row_number")).withColumns({c: F.lit("") for c in candidates.WORKSHEET})
    path = str(tmp_path / "sheet")
    with pytest.raises(GateError, match="'repeated_candidate_ids': 3"):
        sinks.publish_candidates(made.unionByName(made), path, "r1")
    assert sinks.publish_candidates(made, path, "r1") == 3
    found = P.read_published(spark, path)
    assert found.columns == [*candidates.EVIDENCE, *candidates.WORKSHEET] and found.count() == 3
    rows = sinks.output_rows(spark, path)
    assert rows.first()[0] == 3 and "Scan parquet" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast_entries", [1000, 0])
def test_newest_at(spark, broadcast_entries):
    rng = np.random.default_rng(2)
    key = lambda: [None, "a", "b", "c", "hot", "hot", "hot"][rng.integers(7)]
    time = lambda: None if rng.integers(12) == 0 else int(rng.integers(60))
    entries = [(key(), time(), int(rng.integers(1000))) for _ in range(60)]
    rows = [(i, key(), time()) for i in range(200)]
    got = newest_at(
        spark.createDataFrame(rows, "id long, k string, t long"), spark.createDataFrame(entries, "k string, t long, v long"), "k", "t", "v", broadcast_entries
    )
    assert got.columns == ["id", "k", "t", "v"]
    for i, k, t, v in got.collect():
        before = [(s, w) for j, s, w in entries if None not in (j, s, k, t) and j == k and s <= t]
        assert v == (max(before)[1] if before else None)
    assert got.count() == 200
    joins = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in joins) == bool(broadcast_entries)
    none = newest_at(spark.createDataFrame(rows, "id long, k string, t long"), spark.createDataFrame([], "k string, t long, v long"), "k", "t", "v", broadcast_entries)
    assert none.count() == 200 and none.where("v is not null").count() == 0


def people(spark, n=400):
    rows = [(i + 2, ["call 512-555-0199", "a@b.example and 206 555 0143", "", "nothing", None][i % 5], "9 Old Mill Rd" if i % 3 == 0 else "x") for i in range(n)]
    return spark.createDataFrame(rows, "row_number long, note string, place string").repartition(7)


def test_first_findings_are_cut_in_the_tasks(spark, monkeypatch):
    found = privacy.pii_scan(people(spark), ["note", "place"])
    every = found.orderBy("row_number", "field_position", "pattern_position").collect()
    for n in (1, 3, 25, 10_000):
        cut = privacy.first_findings(found, n)
        assert [tuple(r)[:4] for r in cut.collect()] == [tuple(r)[:4] for r in every[:n]]
        assert {r["total_findings"] for r in cut.collect()} == {len(every)}
    plan = privacy.first_findings(found, 25)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and plan.count("MapInArrow") == 3  # nothing is staged; one pass
    assert privacy.first_findings(found.where("row_number < 0")).collect() == []


def test_counts_keep_records_together(spark):
    df = people(spark)
    want = privacy.finding_counts(privacy.pii_scan(df, ["note", "place"])).orderBy("field", "kind").collect()
    found = privacy.scan_counts(df, ["note", "place"])
    assert found.orderBy("field", "kind").collect() == want and len(want) == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
    # Two files count their records from 2, both.
    twice = {(r["field"], r["kind"]): r["records"] for r in privacy.scan_counts(df.unionByName(df), ["note", "place"]).collect()}
    assert twice == {(r["field"], r["kind"]): 2 * r["records"] for r in want}
    assert collections.Counter(r["kind"] for r in want) == {"phone": 1, "email": 1, "street_address": 1}
