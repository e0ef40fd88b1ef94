"""Vectors as short codes: each is cut in equal parts, and each part is named by the nearest entry of its own codebook.

All arithmetic is on integers, ``floor(SCALE * x)`` of every component, so results do not depend on the order of rows.

* **Distinct parts.** A part is a key of its position and its numbers, big-endian, so that keys sort as the parts do.
  Tasks count equal parts of their own rows first; the counted keys are dealt by range, so a task holds a contiguous
  piece of the lexicographic order, which is a piece of the trie of all parts. A vector that fills a third of the
  table is one key.
* **Trie.** A task walks the trie of its sorted parts depth first. A node holds the squared distances of its prefix
  to every entry, and hands them to its children, which add one component each: parts with a common prefix share the
  work for it. Subtrees of at most ``BLOCK`` leaves are finished together, depth by depth, with array operations.
  Leaves take the nearest entry, the lower index at ties, and add their numbers, weighted by their counts.
* **Rounds.** Tasks return at most one row for each entry of each codebook; the sums of these rows, parts times entries
  of them, reach the driver and give the next codebooks, which is also all that is broadcast.
* **Codes.** The final codebooks are applied to the vectors where they lie, with a trie of each batch's parts.

Defined results: vectors that are null or hold null or non-finite components are left out; repeated rows and repeated
ids are coded row by row; ids that are null come last among the smallest ids, equal ids are ordered by their vectors.
With fewer vectors than entries the codebooks are as long as the table. An empty table gives an empty result. Other
columns than the id, the vector and the label are not looked at. Vectors of unequal lengths, lengths that ``parts`` does
not divide, and components so large that 64 bits cannot hold the sums are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import join_groups
from recordloom.session import ship_package, stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Subtrees of at most so many leaves are finished at once.
BLOCK = 4096
#: A task counts up to so many parts before it passes the distinct ones on.
HELD_PARTS = 1 << 19
_BIAS = 1 << 31


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``parts``, which are sorted lexicographically, in the trie's order."""
    n, width = parts.shape
    entry, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    if not n:
        return entry, distance
    unlike = parts[1:] != parts[:-1]
    # How many leading numbers a leaf shares with the leaf before it; the first leaf shares none.
    shared = np.r_[-1, np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)]

    def finish(low: int, high: int, depth: int, node: np.ndarray, sums: np.ndarray) -> None:
        """Leaves ``low`` to ``high`` from their nodes at ``depth``, whose distances are ``sums``, down to the leaves."""
        for d in range(depth, width):
            opens = shared[low:high] <= d
            opens[0] = True
            first = np.flatnonzero(opens)
            sums = sums[node[first]] + (parts[low + first, d, None] - book[None, :, d]) ** 2
            node = np.cumsum(opens) - 1
        best = sums.argmin(axis=1)
        entry[low:high] = best[node]
        distance[low:high] = sums[np.arange(len(sums)), best][node]

    def visit(low: int, high: int, depth: int, sums: np.ndarray) -> None:
        """The subtree of leaves ``low`` to ``high`` below a node at ``depth`` with distances ``sums``."""
        if high - low <= BLOCK or depth == width:
            finish(low, high, depth, np.zeros(high - low, np.int64), sums[None, :])
            return
        opens = shared[low:high] <= depth
        opens[0] = True
        starts = low + np.flatnonzero(opens)
        ends = np.r_[starts[1:], high]
        below = sums + (parts[starts, depth, None] - book[None, :, depth]) ** 2
        child = 0
        while child < len(starts):
            if ends[child] - starts[child] > BLOCK:
                visit(int(starts[child]), int(ends[child]), depth + 1, below[child])
                child += 1
                continue
            # Small neighbours are finished together, as many as fit a block.
            last = max(int(np.searchsorted(ends, starts[child] + BLOCK, side="right")), child + 1)
            sizes = ends[child:last] - starts[child:last]
            finish(int(starts[child]), int(ends[last - 1]), depth + 1, np.repeat(np.arange(last - child), sizes), below[child:last])
            child = last

    visit(0, n, 0, np.zeros(len(book), np.int64))
    return entry, distance


# --- keys of parts -----------------------------------------------------------------------------------


def _integers(column: pa.Array) -> np.ndarray:
    """The scaled components of a batch of vectors, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1)


def _keys(integers: np.ndarray, parts: int) -> np.ndarray:
    """A key for every part: its position in one byte, then its numbers in four bytes each."""
    n, dims = integers.shape
    width = dims // parts
    keys = np.empty((n, parts, 1 + 4 * width), np.uint8)
    keys[:, :, 0] = np.arange(parts)
    keys[:, :, 1:] = (integers + _BIAS).astype(">u4").reshape(n, parts, width).view(np.uint8)
    return keys.reshape(n * parts, -1).view(f"S{1 + 4 * width}").ravel()


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, numbers) of sorted keys."""
    octets = keys.view(np.uint8).reshape(len(keys), -1)
    return octets[:, 0], np.ascontiguousarray(octets[:, 1:]).view(">u4").astype(np.int64) - _BIAS


def _binary(keys: np.ndarray) -> pa.Array:
    width = keys.dtype.itemsize
    offsets = pa.py_buffer((np.arange(len(keys) + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, offsets, pa.py_buffer(keys.tobytes())])


def _by_position(position: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of one position in sorted keys."""
    starts = np.flatnonzero(np.r_[True, position[1:] != position[:-1]]) if len(position) else []
    for low, high in zip(starts, [*starts[1:], len(position)]):
        yield int(position[low]), slice(int(low), int(high))


def _counted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for low in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([_binary(keys[low : low + (1 << 16)]), pa.array(n[low : low + (1 << 16)])], names=["part", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(_keys(_integers(batch.column("vector")), parts))
                size += len(held[-1])
            if size >= HELD_PARTS:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    return run


def _assigned(books: list[np.ndarray]):
    """Sums and counts of the entries, at most one row for each entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(book) for book in books]
        counts = [np.zeros(len(book), np.int64) for book in books]
        for batch in batches:
            raw = batch.column("part").to_pylist()
            if not raw:
                continue
            position, numbers = _numbers(np.frombuffer(b"".join(raw), f"S{len(raw[0])}"))
            weights = batch.column("n").to_numpy()
            for at, stretch in _by_position(position):
                entry, _ = nearest_entries(numbers[stretch], books[at])
                np.add.at(sums[at], entry, numbers[stretch] * weights[stretch, None])
                np.add.at(counts[at], entry, weights[stretch])
        used = [(at, int(e)) for at in range(len(books)) for e in np.flatnonzero(counts[at])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([at for at, _ in used], pa.int32()),
                pa.array([e for _, e in used], pa.int32()),
                pa.array([int(counts[at][e]) for at, e in used], pa.int64()),
                pa.array([sums[at][e].tolist() for at, e in used], pa.list_(pa.int64())),
            ],
            names=["position", "entry", "n", "sums"],
        )

    return run


def _coded(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, back = np.unique(_keys(_integers(batch.column("vector")), len(books)), return_inverse=True)
            position, numbers = _numbers(keys)
            entry, distance = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            for at, stretch in _by_position(position):
                entry[stretch], distance[stretch] = nearest_entries(numbers[stretch], books[at])
            entries = entry[back].reshape(batch.num_rows, -1)
            error = distance[back].reshape(batch.num_rows, -1).sum(axis=1)
            codes = pa.array([bytes(row).hex() for row in entries.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(error)], names=["id", "label", "code", "error"])

    return run


# --- Spark -------------------------------------------------------------------------------------------


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _checked(kept: DataFrame, parts: int) -> int:
    """The number of vectors, once their lengths and components are known to be fit."""
    vector = F.col("vector")
    largest = F.max(F.greatest(F.abs(F.array_max(vector)), F.abs(F.array_min(vector))))
    seen = kept.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"), largest.alias("largest")).first()
    if not seen.n:
        return 0
    if seen.low != seen.high or seen.low % parts or not seen.low:
        raise ValueError(f"vectors of {seen.low} to {seen.high} components cannot be cut in {parts} equal parts")
    bound = math.floor(SCALE * seen.largest) + 1
    if bound >= _BIAS or seen.low * (2 * bound) ** 2 >= 1 << 63 or bound * seen.n >= 1 << 63:
        raise ValueError("components are too large for sums in 64 bits")
    return seen.n


def learn_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook (entries x components) for each part position of ``kept`` (id, vector)."""
    smallest = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries)
    first = np.floor(SCALE * np.array([r["vector"] for r in smallest.collect()], np.float64)).astype(np.int64)
    books = [np.ascontiguousarray(part) for part in np.split(first, parts, axis=1)]
    counted = kept.select("vector").mapInArrow(_counted(parts), "part binary, n bigint")
    # Grouping by the key the rows were dealt by needs no further exchange.
    distinct = counted.repartitionByRange("part").groupBy("part").agg(F.sum("n").alias("n"))
    table = stage(distinct.sortWithinPartitions("part"), "distinct_parts")
    for _ in range(rounds):
        found = table.mapInArrow(_assigned(books), "position int, entry int, n bigint, sums array<bigint>")
        width = books[0].shape[1]
        totals = found.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        for row in totals.collect():  # parts x entries rows
            books[row.position][row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    return books


def encode(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error), codebooks): codes hold two hex digits for each part, errors are summed over the parts."""
    if entries > 256 or parts > 256:
        raise ValueError("entries and positions are one byte each")
    ship_package(vectors.sparkSession)
    as_double = F.col(vector).cast("array<double>")
    kept = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), as_double.alias("vector")).where(_usable(F.col("vector")))
    kinds = dict(kept.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    if not _checked(kept, parts):
        return vectors.sparkSession.createDataFrame([], schema), []
    books = learn_codebooks(kept, parts, entries, rounds)
    return kept.mapInArrow(_coded(books), schema), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over the rows of one label; rows without a label are one group."""
    rows = stage(coded.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "coded")
    groups = stage(rows.groupBy("_group").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label_errors")
    return join_groups(rows, groups, "_group", "_n", rows.count()).drop("_group", "_n")


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
