"""Time the headline operators and print one JSON line.

Inputs come from $BENCH_SF_DIR, cores from $BENCH_CPUS. Snapshots are landed first, as the operators
expect them (all-text Parquet copies in as many files as there are cores); landing is reported beside the queries, not among them. Every
query then runs in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from recordloom.operators import privacy, profile
from recordloom.plans import audit, candidates, review
from recordloom.session import build_session, release, shared_dir, stage
from recordloom.sources import snapshot
from workload import queries as Q
from workload import tables as T

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def landed_tables(spark) -> str:
    """The driver tables, each of which is one file with one row group, as a cluster would hold them: in several files."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/tables"
    for name in ("documents", "benchmark", "conversations", "pages", "part", "supplier", "events"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS)).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", "bench", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    landing = time.perf_counter()
    landed = {
        name: stage(make(spark, SF_DIR).repartition(int(CPUS)), name)
        for name, make in {
            "lineitem": T.lineitem_snapshot,
            "orders": T.orders_snapshot,
            "events": T.events_snapshot,
            "documents": Q._documents,
            "pages": Q._pages,
            "people": Q._people,
            "review": Q._review,
        }.items()
    }
    campaign, *public = (
        replace(source, df=stage(source.df.repartition(int(CPUS)), source.contract.slug))
        for source in (T.campaign_source(spark, SF_DIR), *T.public_sources(spark, SF_DIR))
    )
    tables = landed_tables(spark)
    landing = time.perf_counter() - landing

    def profiled(name, contract):
        return lambda: profile.profile_fields(landed[name], contract, T.AS_OF_YEAR)

    def audited():
        return audit.public_audit(*candidates.staged_names(campaign, public), public)

    sides = campaign.df.count() + sum(source.df.count() for source in public)
    rows = {name: df.count() for name, df in landed.items()}
    headline = {
        "profile_lineitem": (profiled("lineitem", T.LINEITEM), rows["lineitem"]),
        "profile_orders": (profiled("orders", T.ORDERS), rows["orders"]),
        "profile_events": (profiled("events", T.EVENTS), rows["events"]),
        "pii_scan_documents": (lambda: privacy.audit_source(landed["documents"], Q.TEXTS), rows["documents"]),
        "pii_scan_pages": (lambda: privacy.audit_source(landed["pages"], Q.PAGES), rows["pages"]),
        "pii_scan_people": (lambda: privacy.audit_source(landed["people"], Q.PEOPLE), rows["people"]),
        "candidates": (lambda: candidates.generate_candidates(campaign, public, Q.LIMIT), sides),
        "audit_public": (audited, sides),
        "strict_name_key": (lambda: Q.strict_name_key(spark, tables), rows["documents"]),
        "row_fingerprint": (lambda: Q.row_fingerprint(spark, tables), rows["documents"]),
        "review_violations": (lambda: review.review_violations(landed["review"]), rows["review"]),
        "group_report": (lambda: review.group_report(landed["review"]), rows["review"]),
        "manifest_violations": (lambda: Q.manifest_violations(spark, tables), rows["events"]),
        "scan_snapshot": (lambda: Q.scan_snapshot(spark, tables), rows["documents"]),
    }
    # Compile the paths once on small tables; what is timed is the work.
    run(profile.profile_fields(landed["events"].limit(1000), T.EVENTS, T.AS_OF_YEAR))
    run(review.review_violations(landed["review"].limit(1000)))
    warm = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/warm-csv"
    landed["events"].limit(1000).write.csv(warm, header=True)
    run(snapshot.scan_snapshot(spark, warm))

    seconds, rate = {}, {}
    for name, (query, size) in headline.items():
        start = time.perf_counter()
        run(query())
        seconds[name] = round(time.perf_counter() - start, 3)
        rate[name] = round(size / seconds[name])
    print(
        json.dumps(
            {
                "metric": "headline operators, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": rate,
                "landing_sec": round(landing, 3),
                "sf": os.path.basename(SF_DIR).removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
