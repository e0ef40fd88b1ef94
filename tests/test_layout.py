"""Review tables that lie by their ids."""

import re

import pytest
from pyspark.sql import functions as F

from recordloom.plans import candidates as C
from recordloom.plans import review
from recordloom.sources.layout import lay_out, open_layout
from tests.test_review import pairs


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def rows(spark):
    return spark.createDataFrame([(i, f"{i % 90:016x}" if i % 7 else "bad", f"fp{i}") for i in range(200)] + [(300, None, "x")], "row_number long, candidate_id string, fp string")


@pytest.mark.parametrize("again", [False, True])
def test_the_review_side_needs_no_exchange(spark, tmp_path, no_broadcast, again):
    reviewed = lay_out(rows(spark), str(tmp_path / "r"), "candidate_id", 5)
    if again:
        reviewed = open_layout(spark, str(tmp_path / "r"), "candidate_id", 5)
    current = rows(spark).where("row_number % 3 > 0 and row_number < 90").select("candidate_id", F.col("fp").alias("_current"))
    drift = review.fingerprint_drift(current, reviewed, "candidate_id", "fp", "row_number")
    assert exchanges(drift) == 1  # of the candidates
    assert exchanges(review.fingerprint_drift(current, rows(spark), "candidate_id", "fp", "row_number")) == 2
    plain = review.fingerprint_drift(current, rows(spark), "candidate_id", "fp", "row_number")
    assert sorted(map(str, drift.collect())) == sorted(map(str, plain.collect()))
    found = review.id_violations(reviewed, laid_out=True)
    assert exchanges(found) == 0
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, review.id_violations(rows(spark)).collect()))


def test_new_candidates_are_dealt_to_the_review(spark, tmp_path, no_broadcast):
    made = pairs(spark, 6).drop("row_number")
    existing = lay_out(made.limit(2), str(tmp_path / "e"), "candidate_id", 3)
    fresh = review.init_review(made, existing)
    assert exchanges(fresh) == 1 + exchanges(made) and fresh.count() == 4
    assert tuple(fresh.columns) == (*C.EVIDENCE, *review.REVIEW)
