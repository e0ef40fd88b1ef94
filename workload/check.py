"""Compare every registered query with its SQL: ``python -m workload.check [sf_dir] [name ...]``."""

from __future__ import annotations

import hashlib
import sys
import time
from decimal import Decimal

import duckdb

from recordloom.session import build_session, release
from workload.queries import ORACLE, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}" if abs(float(value)) < 1e-3 else f"{float(value):.4f}"
    return str(value)


def digest(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(normal(row[i]) for i in order) for row in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in ORACLE:
        return False, f"{len(rows)} rows, no SQL, {spent:.1f}s"
    result = con.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    ours, left = digest(rows, df.columns)
    theirs, right = digest(want, columns)
    if ours == theirs:
        return True, f"{len(rows)} rows, {spent:.1f}s"
    only = [line for line in left if line not in set(right)][:3], [line for line in right if line not in set(left)][:3]
    return False, f"{len(rows)} vs {len(want)} rows; ours only {only[0]}; SQL only {only[1]}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            good, note = compare(spark, con, sf_dir, name)
        except Exception as error:
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name}: {note[:1500]}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    release(spark)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
