import csv
import json

import pytest
from pyspark.sql import functions as F

from recordloom.operators import schema
from recordloom.sources.catalog import read_column_catalog
from recordloom.sources.contracts import ContractError
from recordloom.sources.snapshot import (
    land_snapshot,
    ragged_records,
    read_header,
    scan_snapshot,
    with_row_number,
)


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def python_rows(path):
    with open(path, encoding="utf-8-sig", newline="") as handle:
        return [dict(row) for row in csv.DictReader(handle)]


TRICKY = (
    '﻿Vendor Name,Note,Amount\r\n'
    '"ACME ""Best"", LLC"," padded ",1\r\n'
    '\r\n'
    '"two\nlines",,2\r\n'
    'plain,"",3\r\n'
)


def test_scan_matches_csv_reader(spark, tmp_path):
    path = write(tmp_path / "t.csv", TRICKY)
    got = with_row_number(spark, path).orderBy("row_number").collect()
    want = python_rows(path)
    assert [r["row_number"] for r in got] == [2, 3, 4]
    for row, expected in zip(got, want):
        assert [row["vendor_name"], row["note"], row["amount"]] == list(expected.values())


def test_short_and_long_records(spark, tmp_path):
    text = "a,b,c\n1,2,3\n4,5\n6,7,8,9\n10\n11,12,13,\n,,\n14,,\n15,\n"
    path = write(tmp_path / "r.csv", text)
    rows = with_row_number(spark, path).orderBy("row_number").select("a", "b", "c").collect()
    want = [tuple(r.get(k) for k in "abc") for r in python_rows(path)]
    assert [tuple(r) for r in rows] == want
    kinds = {r["kind"]: r["n"] for r in ragged_records(spark, path).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"short": 3, "long": 2}


@pytest.mark.parametrize("multi_line", [True, False])
def test_landing_numbers_every_file(spark, tmp_path, multi_line):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(5):
        rows = "".join(f"f{k},{i}\n" for i in range(3000 + k))
        write(folder / f"part{k}.csv", "File,Seq\n" + rows)
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        landed = land_snapshot(spark, str(folder), str(tmp_path / "out"), multi_line=multi_line)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    assert landed.count() == 15010
    wrong = landed.where(F.col("row_number") != F.col("seq").cast("long") + 2)
    assert wrong.count() == 0
    with pytest.raises(Exception, match="(?i)already exists"):
        land_snapshot(spark, str(folder), str(tmp_path / "out"), multi_line=multi_line)


def test_header_rules(spark, tmp_path):
    with pytest.raises(ContractError):
        scan_snapshot(spark, write(tmp_path / "d.csv", "a,a\n1,2\n"))
    with pytest.raises(ContractError):
        scan_snapshot(spark, write(tmp_path / "c.csv", "Vendor Name,vendor-name\n1,2\n"))
    with pytest.raises(ContractError):
        scan_snapshot(spark, write(tmp_path / "e.csv", "a,%%\n1,2\n"))
    assert read_header(spark, write(tmp_path / "b.csv", TRICKY)) == ["Vendor Name", "Note", "Amount"]


def test_file_with_other_header_fails(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", "x,y\n1,2\n")
    write(folder / "b.csv", "y,x\n1,2\n")
    with pytest.raises(Exception):
        scan_snapshot(spark, str(folder)).collect()


def test_catalog_and_column_map(spark, tmp_path):
    fields = {"Well No.": "well", "Depth (m)": "depth_in_metres", "Surveyor": "surveyor"}
    meta = {"id": "wells", "columns": [{"name": n, "fieldName": f, "dataTypeName": "text"} for n, f in fields.items()]}
    catalog = read_column_catalog(spark, write(tmp_path / "wells.json", json.dumps(meta, indent=2)))
    assert {(r["name"], r["field_name"]) for r in catalog.select("name", "field_name").collect()} == set(fields.items())
    mapping = schema.column_map_dict(schema.column_map(catalog, by="dataset_id"))
    # A field answers to its API name and to the canonical form of its display name.
    assert mapping == {"well_no": "well", "well": "well", "depth_m": "depth_in_metres", "depth_in_metres": "depth_in_metres", "surveyor": "surveyor"}
    data = write(tmp_path / "wells.csv", "Depth (m),Surveyor,Rock Kind\n12,Ida,chalk\n")
    assert scan_snapshot(spark, data, mapping).columns == ["depth_in_metres", "surveyor", "rock_kind"]
    meta["columns"].append({"name": "WELL", "fieldName": "well_type"})
    clash = read_column_catalog(spark, write(tmp_path / "clash.json", json.dumps(meta)))
    with pytest.raises(ContractError, match="ambiguous"):
        schema.column_map_dict(schema.column_map(clash, by="dataset_id"))

