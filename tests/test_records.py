"""Records of quoted CSV files that several tasks read."""

import csv
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.sources import records
from recordloom.sources.contracts import ContractError
from recordloom.sources.snapshot import land_snapshot, ragged_records, with_row_number

CELLS = ["", "plain", " padded ", 'said "so"', "a,b", "two\nlines", "\n", '"', '""', "x\r\ny", "é\n中文", ",", '\n"\n,"', "long " * 30]


def written(rows, ending="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows(rows)
    return out.getvalue()


def read(text):
    return list(csv.reader(io.StringIO(text, newline="")))


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks, ending):
    rng = np.random.default_rng(len(ending))
    rows = [["Id", "First", "Second"]] + [[str(i), *(CELLS[k] for k in rng.integers(0, len(CELLS), 2))] for i in range(400)]
    rows[200][1] = "one cell\n" * 300  # fills several blocks
    text = written(rows, ending)
    path = tmp_path / "t.csv"
    path.write_bytes(("﻿" + text).encode())
    starts, split = records.block_starts(spark, str(path))
    assert split and len(starts) > 20 and any(inside for inside, _ in starts.values())
    got = with_row_number(spark, str(path))
    assert got.rdd.getNumPartitions() > 4
    found = [[r["id"], r["first"], r["second"]] for r in got.orderBy("row_number").collect()]
    assert found == read(text)[1:] == rows[1:]
    numbers = sorted(r["row_number"] for r in got.select("row_number").collect())
    assert numbers == list(range(2, 402))


def test_landing_writes_the_copy_alone(spark, tmp_path, small_blocks, monkeypatch):
    """The numbers come with the records: nothing is staged, no join, and no exchange of records that lie in one block."""
    from recordloom import session

    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(300)))
    monkeypatch.setattr(session, "stage", None)
    landed = land_snapshot(spark, str(path), str(tmp_path / "out"))
    assert landed.where(F.col("row_number") != F.col("a").cast("long") + 2).count() == 0 and landed.count() == 300
    plan = with_row_number(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1  # of the pieces of records


def test_ragged_records_are_named(spark, tmp_path, small_blocks):
    lines, want = ["a,b,c"], set()
    for i in range(200):
        if i % 7 == 3:
            lines.append(f'{i},"x\n""y""",z,extra')
            want.add((i + 2, "long"))
        elif i % 7 == 5:
            lines.append(f'{i},"only\ntwo"')
            want.add((i + 2, "short"))
        else:
            lines.append(f'{i},"fine\n",z')
        if i % 10 == 0:
            lines.append("")  # blank lines are no records
    path = tmp_path / "r.csv"
    path.write_text("\n".join(lines) + "\n")
    found = {(r["row_number"], r["kind"]) for r in ragged_records(spark, str(path)).collect()}
    assert found == want
    rows = {r["row_number"]: (r["b"], r["c"]) for r in with_row_number(spark, str(path)).collect()}
    assert rows[5] == ('x\n"y"', "z") and rows[7] == ("only\ntwo", None) and len(rows) == 200


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('a,b\n1,5" pipe\n2,x\n', [["1", '5" pipe'], ["2", "x"]]),  # a quote inside a plain cell is text
        ('a,b\n1,"open to the end\nstill\n', [["1", "open to the end\nstill"]]),
        ("a,b\n1,2", [["1", "2"]]),
        ('a,b\n\n\r\n1,"\n\n"\n\n', [["1", "\n\n"]]),
        ('"a\nx",b\n1,2\n', [["1", "2"]]),
        ("a,b\n", []),
        ("a,b", []),
    ],
)
def test_shapes(spark, tmp_path, text, want):
    path = tmp_path / "s.csv"
    path.write_bytes(text.encode())
    got = with_row_number(spark, str(path)).orderBy("row_number")
    assert [list(r)[:2] for r in got.collect()] == want
    assert [r["row_number"] for r in got.collect()] == list(range(2, len(want) + 2))


def test_end_of_line_cases_agree_with_a_csv_reader():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        line = "".join(rng.choice(list('",a '), int(rng.integers(0, 9))))
        # An open cell takes the next line into its record.
        assert records.ends_inside(line, False) == (len(read(line + "\nz\n")) == 1 and line != ""), line
        assert records.ends_inside(line, True) == (len(read('"' + line + "\nz\n")) == 1), line


def test_a_folder_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,z\n1,2\n")
    with pytest.raises(Exception, match="another CSV header"):
        with_row_number(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    with pytest.raises(ContractError, match="missing CSV header"):
        with_row_number(spark, str(tmp_path / "empty"))


def test_too_many_blocks_are_refused(spark, tmp_path, small_blocks, monkeypatch):
    (tmp_path / "a.csv").write_text("x,y\n" + "1,2\n" * 1000)
    monkeypatch.setattr(records, "MOST_BLOCKS", 3)
    with pytest.raises(ContractError, match="maxPartitionBytes"):
        with_row_number(spark, str(tmp_path))


def test_batches_of_short_records_are_bounded():
    """However short its records, a task holds some thousands of them, not millions."""
    from types import SimpleNamespace

    def lines():
        for low in range(0, 60_000, 10_000):
            columns = [pa.array([str(i) for i in range(low, low + 10_000)]), pa.array(["f"] * 10_000), pa.array([0] * 10_000, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "file", "block"])

    run = records._read(SimpleNamespace(value={("f", 0): (False, 0)}), True, pieces=False)
    batches = list(run(lines()))
    assert max(b.num_rows for b in batches) <= 10_000
    assert [r for b in batches for r in b.column("record").to_pylist()] == [str(i) for i in range(60_000)]
    assert [n for b in batches for n in b.column("number").to_pylist()] == list(range(1, 60_001))
