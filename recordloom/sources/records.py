"""Records of quoted CSV files, read by many tasks.

A record may hold line breaks inside quoted cells, so a task that starts in the middle of a file does not know whether it
starts inside a cell. Files are therefore read by lines, in the blocks that Spark cuts them into, and twice:

1. Every block is summed up for both cases: whether it ends inside a cell, and how many records start in it, if it
   begins outside a cell and if it begins inside one. A line is in one of these two cases, too, since a line break
   outside quotes ends the record.
2. The table of blocks (one row for each block of ``spark.sql.files.maxPartitionBytes``) is put in order and scanned:
   each block's case and the number of its first record follow from the blocks before it.
3. Every block is read again, now from its own first record on. Records that lie in one block come out whole; of the others
   each block gives its piece, and the pieces, at most two from each block, are put together by record.

Records carry their number in the file from then on, whatever later happens to their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import ship_package
from recordloom.sources.contracts import ContractError

#: Blocks that the driver puts in order and the tasks look their own up in: 512 TB at Spark's usual block size.
MOST_BLOCKS = 1 << 22
#: Characters of one batch of records, each of which counts for some more than its text: a short one weighs little else in Python.
_BATCH_CHARS, _RECORD_CHARS = 2 << 20, 256
_BLANK = ("", "\r")
_BOM = "﻿"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside one, or outside.

    A quote opens a cell only where the cell starts; a doubled quote is a quote of the cell's text.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            at = line.find(",", at + 1)  # what follows a closing quote belongs to the cell
            if at < 0:
                return False
            at, inside = at + 1, False
        elif line.startswith('"', at):
            at, inside = at + 1, True
        else:
            at = line.find(',"', at)
            if at < 0:
                return False
            at, inside = at + 2, True


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(value, file, block): lines in file order within a block. Only line feeds divide them, so cells stay as they are."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list[str]]]:
    """(file, block, whether the block begins, lines) for the stretches of one block."""
    last = None
    for batch in batches:
        n, files = batch.num_rows, batch.column("file")
        if not n:
            continue
        blocks = batch.column("block").to_numpy()
        other = pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | other) + 1).tolist(), n]
        values = batch.column("value").to_pylist()
        for low, high in zip(cuts, cuts[1:]):
            key = (files[low].as_py(), int(blocks[low]))
            begins = key != last
            last = key
            lines = values[low:high]
            if begins and not key[1]:
                lines[0] = lines[0].removeprefix(_BOM)
            yield *key, begins, lines


def _summed(multi_line: bool):
    """(file, block, then the end and the number of records if the block begins outside a cell, and if inside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ends, counts = [], [False, True], [0, 0]
        key = None
        for file, block, begins, lines in _stretches(batches):
            if begins:
                if key is not None:
                    rows.append((*key, *ends, *counts))
                key, ends, counts = (file, block), [False, True], [0, 0]
            for line in lines:
                quoted = multi_line and '"' in line
                for case in (0, 1):
                    if not ends[case] and line not in _BLANK:
                        counts[case] += 1
                    if quoted:
                        ends[case] = ends_inside(line, ends[case])
        if key is not None:
            rows.append((*key, *ends, *counts))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        names = ["file", "block", "end0", "end1", "n0", "n1"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def block_starts(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = True
) -> tuple[dict[tuple[str, int], tuple[bool, int]], bool]:
    """For each (file, block): whether it begins inside a cell, and how many records of its file start before it.

    Also whether any block begins, or any file ends, inside a cell; if not, no record is in pieces.
    """
    ship_package(spark)
    schema = "file string, block bigint, end0 boolean, end1 boolean, n0 bigint, n1 bigint"
    blocks = _lines(spark, path).mapInArrow(_summed(multi_line), schema)
    rows = blocks.collect()  # Spark's own limit on results stops a much larger table before this one does
    if len(rows) > MOST_BLOCKS:
        raise ContractError(f"more than {MOST_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    starts: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, seen, split = None, False, 0, False
    for row in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if row["file"] != file:
            file, inside, seen = row["file"], False, 0
        starts[row["file"], row["block"]] = (inside, seen)
        inside, seen = (row["end1"], seen + row["n1"]) if inside else (row["end0"], seen + row["n0"])
        split = split or inside
    return starts, split


def _read(shared, multi_line: bool, pieces: bool):
    """(file, number, block, record): whole records, or with ``pieces`` the parts of those that several blocks share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        out: list[tuple[str, int, int, str]] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["file", "number", "block", "record"])

        key, inside, number, head, held = None, False, 0, False, []
        for file, block, begins, lines in _stretches(batches):
            if begins:
                if held and pieces:
                    out.append((*key[:1], number, key[1], "\n".join(held)))
                key, held = (file, block), []
                inside, number = starts[key]
                head = inside
            for line in lines:
                if not inside:
                    if line in _BLANK:
                        continue
                    number += 1
                if multi_line and '"' in line:
                    inside = ends_inside(line, inside)
                if inside:
                    held.append(line)
                    continue
                record, partial = ("\n".join([*held, line]), head) if held or head else (line, False)
                held, head = [], False
                if partial == pieces:
                    out.append((file, number, block, record))
                    size += len(record) + _RECORD_CHARS
                    if size >= _BATCH_CHARS:
                        yield batch_of()
                        out, size = [], 0
        if held and pieces:
            out.append((key[0], number, key[1], "\n".join(held)))
        if out:
            yield batch_of()

    return run


def read_records(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """(file, number, record): the text of every record of CSV files, numbered in its file from 1, which is the header.

    Blank lines between records are not records. With ``multi_line=False`` every line is one. A cell that is still open at
    the end of a file ends there. Memory: a record, however many blocks it fills, is one value.
    """
    starts, split = block_starts(spark, path, multi_line)
    shared = spark.sparkContext.broadcast(starts)
    schema = "file string, number bigint, block bigint, record string"
    records = _lines(spark, path).mapInArrow(_read(shared, multi_line, pieces=False), schema).select("file", "number", "record")
    if split:
        parts = _lines(spark, path).mapInArrow(_read(shared, multi_line, pieces=True), schema)
        in_order = F.sort_array(F.collect_list(F.struct("block", "record")))
        whole = parts.groupBy("file", "number").agg(F.array_join(F.transform(in_order, lambda piece: piece["record"]), "\n").alias("record"))
        records = records.unionByName(whole)
    ended = F.col("record").endswith("\r")
    return records.withColumn("record", F.when(ended, F.expr("substr(record, 1, length(record) - 1)")).otherwise(F.col("record")))
