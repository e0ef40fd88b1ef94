"""Listing, content index and documents of the store."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from recordloom.sources import catalog
from recordloom.sources import content_index as I
from recordloom.sources import documents, listing
from recordloom.sources import manifests as M
from recordloom.sources.contracts import contract_sources
from recordloom.sources.inventory import INVENTORY
from recordloom.streaming.landing import land_new_files


def test_listing_finds_every_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "_CHUNK", 2)
    want = {}
    for name, size in (("top.csv", 0), ("also here.csv", 3), ("a/one.csv", 1), ("a/b/two.txt", 0), ("a/b/c/three.csv", 5), ("d/.keep", 0)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)
        want[f"file:{path}"] = size
    (tmp_path / "nothing").mkdir()
    found = listing.list_tree(spark, str(tmp_path)).collect()
    assert {r["path"]: r["bytes"] for r in found} == want and len(found) == len(want)
    empty = listing.list_empty_files(spark, f"file://{tmp_path}", ".csv").collect()
    assert [r["path"] for r in empty] == [f"file:{tmp_path}/top.csv"]
    assert listing.list_tree(spark, str(tmp_path / "nothing")).collect() == []


def artifacts(spark, contents):
    return spark.createDataFrame([(f"data/raw/d/{hashlib.sha256(c.encode()).hexdigest()}.csv",) for c in contents], "artifact string")


def test_index_reads_the_wanted_prefixes_only(spark, tmp_path):
    index = str(tmp_path / "index")
    batch = artifacts(spark, ["a", "b", "zz"])
    assert I.stored_among(spark, batch, index).collect() == []
    I.add_to_index(artifacts(spark, [str(i) for i in range(300)] + ["a"]), index, 0)
    I.add_to_index(artifacts(spark, ["b", "other"]), index, 1)
    found = I.stored_among(spark, batch, index)
    assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in artifacts(spark, ["a", "b"]).collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(prefix" in plan
    # Of some 180 prefix folders only those of the three hashes are read.
    scan = spark.read.schema(I.INDEX_SCHEMA).parquet(index)
    prefixes = {r["artifact"].split("/")[-1][:2] for r in batch.collect()}
    assert scan.select("prefix").distinct().count() > 100 and len(prefixes) == 3

    def rows():
        return sorted(map(tuple, spark.read.schema(I.INDEX_SCHEMA).parquet(index).collect()))

    before = rows()
    I.add_to_index(artifacts(spark, ["b", "other"]), index, 1)  # a batch that runs again
    assert rows() == before
    odd = spark.createDataFrame([("no-hash.csv",), (None,)], "artifact string")
    assert I.stored_among(spark, odd, index).collect() == []


def test_an_older_store_is_indexed_once(spark, tmp_path):
    root = tmp_path / "root"
    names = [r[0] for r in artifacts(spark, ["a", "b"]).collect()]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    index = str(tmp_path / "index")
    I.build_index(spark, str(root), index)
    assert sorted(r["artifact"] for r in spark.read.parquet(index).collect()) == sorted(names)


def test_every_landed_file_is_registered_or_reported_once(spark, tmp_path):
    landing, root, table, rejects = tmp_path / "in", tmp_path / "root", str(tmp_path / "manifests"), str(tmp_path / "rejects")
    (landing / "contracts").mkdir(parents=True)
    root.mkdir()
    sources = contract_sources(spark, INVENTORY.values())

    def run():
        land_new_files(spark, str(landing), str(root), table, rejects, sources, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((os.path.basename(r["path"]), r["rule"]) for r in spark.read.parquet(rejects).collect())

    # Empty files alone start no batch, in the root and in a source's folder; they are reported all the same.
    (landing / "root-empty.csv").write_bytes(b"")
    (landing / "contracts" / "empty.csv").write_bytes(b"")
    want = [("empty.csv", "empty"), ("root-empty.csv", "empty")]
    assert run() == want and run() == want
    (landing / "root-file.csv").write_bytes(b"a,b\n1,2\n")
    (landing / "contracts" / "good.csv").write_bytes(b"a,b\n1,2\n")
    want.append(("root-file.csv", "unknown_source"))
    assert run() == want and run() == want
    assert spark.read.parquet(table).count() == 1 and len(list(root.rglob("*.csv"))) == 1
    (landing / "contracts" / "same.csv").write_bytes(b"a,b\n1,2\n")
    (landing / "contracts" / "later-empty.csv").write_bytes(b"")
    assert run() == sorted([*want, ("later-empty.csv", "empty")])
    assert spark.read.parquet(table).count() == 2 and len(list(root.rglob("*.csv"))) == 1


DOCUMENTS = [
    '{"id": "abc", "x": [1, {"id": "no"}]}', '{"x": {"id": "no", "y": "}"}, "id" : "yes"}', '{"a\\"b": "id", "id": "q\\"uo\\\\te"}', "{}",
    '{"id": null}', '{"id": 12.50, "z": 1}', '{"\\u0069d": "escaped"}', '{"id": "first", "id": "last"}', '[{"id": "in a list"}]', '{"id": "cut', "not json",
    "", '{"id": "é中"}', '{"nid": "x", "idx": "y"}', '{"id": true}',
]


def plain_id(text):
    try:
        found = json.loads(text)
    except ValueError:
        return None
    value = found.get("id") if isinstance(found, dict) else None
    return value if value is None or isinstance(value, str) else json.dumps(value).replace("12.5", "12.50")


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_key_reader(size):
    for text in DOCUMENTS:
        reader, data = M.KeyReader("id"), text.encode()
        try:
            for at in range(0, len(data), size):
                reader.feed(data[at : at + size])
            value = reader.value
        except ValueError:
            value = None
        assert value == plain_id(text), text


@pytest.mark.parametrize("whole", [1 << 20, 0, 25])
def test_documents_are_described_in_one_read(spark, tmp_path, whole):
    want = {}
    for i, text in enumerate(DOCUMENTS):
        if text:  # Spark passes over empty files
            (tmp_path / f"d{i}.json").write_text(text)
            value = plain_id(text)
            want[f"d{i}.json"] = (hashlib.sha256(text.encode()).hexdigest(), len(text.encode()), None if text.startswith("[") else value)
    found = M.read_documents(spark, str(tmp_path), whole=whole)
    got = {r["artifact"]: (r["sha256"], r["bytes"], r["id"]) for r in found.collect()}
    assert got == {k: (a, b, v if v != "12.50" or got[k][2] == "12.50" else "12.5") for k, (a, b, v) in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") == 2 and "length" in plan  # small and large ones, split by a pushed filter


def test_document_rules(spark):
    manifest = "manifest string, operation string, source_slug string, artifact string, receipt struct<sha256: string, bytes: bigint>"
    good = hashlib.sha256(b'{"id":"ds"}').hexdigest()
    rows = [
        ("ok", M.FREEZE, "s", "a", (good, 11)), ("gone", M.FREEZE, "s", "b", (good, 11)), ("hash", M.FREEZE, "s", "a", ("x", 11)),
        ("size", M.FREEZE, "s", "a", (good, 10)), ("none", M.FREEZE, "s", "a", None), ("raw", M.ACQUIRE, "s", "b", (good, 11)),
        ("both", M.FREEZE, "t", "a", (good, 1)), ("stranger", M.FREEZE, "u", "a", (good, 11)),
    ]
    contents = spark.createDataFrame([("a", bytearray(b'{"id":"ds"}'))], "artifact string, content binary")
    sources = spark.createDataFrame([("s", "ds"), ("t", "other")], "source string, dataset_id string")
    found = M.document_violations(spark.createDataFrame(rows, manifest), M.describe_documents(contents), sources).collect()
    assert {(r["manifest"], r["rule"]) for r in found} == {
        ("gone", "missing"), ("hash", "integrity_mismatch"), ("size", "integrity_mismatch"), ("none", "integrity_mismatch"),
        ("both", "integrity_mismatch"), ("both", "other_dataset"), ("stranger", "other_dataset"),
    }


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


METADATA = [
    b'{"id":"a","columns":[{"name":"x"}],"rowsUpdatedAt":5}', b'[{"id":"b"},{"id":"c"}]', b"[]", b"  \n", b"null", b"not json", b'{"id":"cut', b"",
    b'{"id":"p","rowsUpdatedAt":"abc"}', b'[{"id":"r","rowsUpdatedAt":"no"},{"id":"s"}]', b'\xef\xbb\xbf{"id":"bom"}', '{"id":"wide"}'.encode("utf-16"),
    b'{"id":"\xff\xfe"}', b'{"id":"x"} {"id":"y"}', b'"text"', b"{}", b'[[{"id":"nested"}]]', b'[5,{"id":"t"}]', b'{"id":"1","id":"2"}',
]


@pytest.mark.parametrize("whole", [1 << 20, 20])
def test_json_files_are_listed_and_read_by_tasks(spark, tmp_path, whole):
    """The rows of Spark's own source, from a folder, files and globs, without a scan that lists the files in the driver."""
    main, parted = tmp_path / "main", tmp_path / "parted"
    for name, content in (
        *((f"main/d {i}%20é.json", content) for i, content in enumerate(METADATA)),
        *((name, b'{"id":"n"}') for name in ("main/_hidden.json", "main/.hidden.json", "main/below/n.json", "parted/kind=x/p.json", "parted/kind=_y/p.json")),
    ):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for path in (str(main), f"file://{main}", [f"{main}/below", f"{main}/d 1%20é.json"], f"{main}/d 1*.json", str(parted)):
        source = spark.read.schema(catalog.METADATA_SCHEMA).json(path, multiLine=True).drop("kind")
        want = source.withColumn("path", F.col("_metadata.file_path"))
        found = documents.read_json(spark, path, catalog.METADATA_SCHEMA, whole)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    found = catalog.read_metadata(spark, str(main))
    assert "FileScan json" not in plan_of(found) and "MapInArrow" in plan_of(found)
    with pytest.raises(Exception, match="does not exist"):
        catalog.read_metadata(spark, str(tmp_path / "none"))


def test_files_are_listed_by_tasks_as_spark_lists_them(spark, tmp_path, monkeypatch):
    for name, content in (("a.csv", "x"), ("b c.txt", "xy"), ("empty.csv", ""), ("s/d.csv", "x"), ("s/_t/e.csv", "x"), ("_h.csv", "x"), (".i.csv", "x"), ("k=_1/j.csv", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    for glob in ("*", "*.csv", "{a,d}.*", "[!a]*", "?.csv"):
        source = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=glob).load(str(tmp_path))
        want = source.select("path", "length", "modificationTime")
        found = M.list_files(spark, str(tmp_path), glob)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        assert "Scan binaryFile" not in plan_of(found)
    # One part of a listing holds as many files as opening and reading them is worth.
    monkeypatch.setattr(listing, "_TASK", 2 * listing._OPENING)
    assert M.list_files(spark, str(tmp_path)).rdd.getNumPartitions() == 3  # of five files


@pytest.mark.parametrize("whole", [1 << 20, 0, 25])
def test_stored_documents_are_those_that_spark_reads(spark, tmp_path, whole):
    for i, text in enumerate(DOCUMENTS):
        (tmp_path / f"d{i}.json").write_text(text)
    found = M.stored_documents(M.list_files(spark, str(tmp_path), "*.json"), str(tmp_path), whole)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, M.read_documents(spark, str(tmp_path), whole=whole).collect()))
    assert "Scan binaryFile" not in plan_of(found)
