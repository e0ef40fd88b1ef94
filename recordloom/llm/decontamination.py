"""Benchmark passages in training text, found with suffix arrays of the training text.

Texts are read as words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased). A window is ``WINDOW``
consecutive words of an item; an item of fewer words, but not none, is one window. A word of a document is hit when it lies
inside an occurrence of a window.

* **Shards.** A task builds one suffix array after another, each over about ``SHARD`` bytes of its own documents; a
  longer document is searched in stretches that overlap by one window. Words that no benchmark item holds cannot be
  part of a match: they have the number 0, end every suffix before them and start none.
* **Array.** Suffixes are sorted by their first word; groups of equals are then refined by the rank of the suffix behind
  the part that is already sorted, doubling the depth until all are told apart or the depth that can matter is reached.
* **Search.** Every suffix of the benchmark that starts a window is found by binary search, all at once; the range
  between both ends holds the places of all its occurrences. ``longest_matches`` searches every suffix of every item
  and compares the two neighbours of its place, which hold its longest verbatim match in the shard.
* **Bounds.** The benchmark reaches the tasks as blocks of at most ``BLOCK_WORDS`` words, one broadcast each; a larger
  benchmark takes several passes over the documents, whose findings are merged in the rows. Documents do not shuffle:
  the hot cases (a passage in a third of all documents, a third of all rows alike) are spread like all other rows.

Defined results: a null or empty text has no words and is clean, in documents and items; repeated documents are judged
row by row; items with one id are one item, whose windows are those of all its texts; an item without an id counts as
one whose id is the empty text. Windows do not cross documents or items. Of an item beyond ``BLOCK_WORDS`` words the
pieces of one block overlap by ``WINDOW - 1`` words, so no window is lost, and the longest match ends with the piece. All
columns of the documents are kept, whatever their names. Empty tables give an empty or a clean result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import byte_words
from recordloom.session import ship_package, stage

WINDOW = 10
SHARD = 8 << 20
#: Words of a stretch that one suffix array covers at most.
STRETCH = 1 << 21
BLOCK_WORDS = 1 << 21

_LOWER = bytes(range(0x61, 0x7B))
_OTHER = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z; what belongs to no word becomes a space.
_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)) + _OTHER, _LOWER + b" " * len(_OTHER))


# --- suffix arrays -----------------------------------------------------------------------------------


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes that start with a number above 0, ordered by up to ``depth`` numbers; a 0 ends a suffix."""
    n = len(ids)
    places = np.flatnonzero(ids)
    order = np.argsort(ids[places], kind="stable")
    array = places[order]
    rank = np.zeros(n + 1, np.int64)
    group_start, sizes = _groups(ids[array])
    rank[array] = group_start + 1
    open_ = np.flatnonzero(sizes > 1)
    known = 1
    while known < depth and len(open_):
        members = array[open_]
        behind = rank[np.minimum(members + known, n)]
        key = rank[members] * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        members, behind = members[order], behind[order]
        array[open_] = members  # groups keep their stretch of the array
        group_start, sizes = _groups(key[order])
        rank[members] = open_[group_start] + 1
        # A suffix that ended is equal to its group for good.
        open_ = open_[(sizes > 1) & (behind > 0)]
        known *= 2
    return array


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the group's first, size of the group) for sorted keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    return np.repeat(starts, sizes), np.repeat(sizes, sizes)


def _ordered(ids: np.ndarray, at: np.ndarray, test: np.ndarray, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): how the suffix at ``at`` compares with the ``length`` numbers of ``test`` from ``query``
    (-1 before, 0 starts with them, 1 behind), and how many numbers agree."""
    order, common = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64)
    going = np.flatnonzero(length > 0)
    while len(going):
        depth = common[going]
        place = at[going] + depth
        own = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], 0)
        wanted = test[query[going] + depth]
        order[going] = np.sign(own - wanted)
        going = going[own == wanted]
        common[going] += 1
        going = going[common[going] < length[going]]
    return order, common


def _bound(ids: np.ndarray, array: np.ndarray, test: np.ndarray, query: np.ndarray, length: np.ndarray, behind: bool) -> np.ndarray:
    """By binary search, the first place in ``array`` not before (or, ``behind``, that comes after) each query."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(array))
    while len(going := np.flatnonzero(low < high)):
        middle = (low[going] + high[going]) // 2
        order, _ = _ordered(ids, array[middle], test, query[going], length[going])
        after = order < (1 if behind else 0)
        low[going] = np.where(after, middle + 1, low[going])
        high[going] = np.where(after, high[going], middle)
    return low


# --- the benchmark -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Block:
    """Items as numbers: ``test`` holds their words, a 0 behind each item, ``item_of`` the item of each place.

    ``starts`` and ``lengths`` name one place for each distinct window; ``owners[offsets[k]:offsets[k + 1]]`` are the
    items that hold window k.
    """

    numbers: dict[bytes, int]
    names: list[str]
    test: np.ndarray
    item_of: np.ndarray
    word_at: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    owners: np.ndarray

    @property
    def reach(self) -> int:
        return int(self.lengths.max(initial=1))


def block_of(pieces: list[tuple[str, int, list[bytes]]], window: int = WINDOW) -> Block:
    """A block of (item, place of its first word in the item, words)."""
    numbers: dict[bytes, int] = {}
    names = sorted({name for name, _, _ in pieces})
    index = {name: k for k, name in enumerate(names)}
    test, item_of, word_at = [], [], []
    owners: dict[tuple[int, ...], tuple[int, set[int]]] = {}
    for name, at, words in pieces:
        own = [numbers.setdefault(word, len(numbers) + 1) for word in words]
        base = len(test)
        for i in range(max(len(own) - window + 1, 1) if own else 0):
            owners.setdefault(tuple(own[i : i + window]), (base + i, set()))[1].add(index[name])
        test += [*own, 0]
        item_of += [index[name]] * (len(own) + 1)
        word_at += [*range(at, at + len(own)), -1]
    held = [sorted(who) for _, who in owners.values()]
    return Block(
        numbers,
        names,
        np.array(test, np.int64),
        np.array(item_of, np.int64),
        np.array(word_at, np.int64),
        np.array([start for start, _ in owners.values()], np.int64),
        np.array([len(content) for content in owners], np.int64),
        np.cumsum([0, *map(len, held)]),
        np.array([k for who in held for k in who], np.int64),
    )


def benchmark_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Block]:
    """The items in blocks of at most BLOCK_WORDS words; rows come to the driver a partition at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    held: list[tuple[str, int, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        words = [word for part in byte_words((row["text"] or "").encode(), _TABLE) for word in part]
        at = 0
        while words[at:]:
            piece = words[at : at + BLOCK_WORDS]
            if size + len(piece) > BLOCK_WORDS and held:
                yield block_of(held)
                held, size = [], 0
            held.append((row["item"], at, piece))
            size += len(piece)
            at += len(piece) if at + len(piece) >= len(words) else len(piece) - WINDOW + 1
    if held:
        yield block_of(held)


# --- documents ---------------------------------------------------------------------------------------


def _numbered(data: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    parts = [np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words)) for words in byte_words(data, _TABLE)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def occurrences(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(place, window) of every occurrence of a window in ``ids``, where a 0 divides documents."""
    places, windows = [], []
    for low in range(0, len(ids), STRETCH):
        part = ids[low : low + STRETCH + block.reach - 1]
        array = suffix_array(part, block.reach)
        if not len(array):
            continue
        first = _bound(part, array, block.test, block.starts, block.lengths, behind=False)
        last = _bound(part, array, block.test, block.starts, block.lengths, behind=True)
        counts = last - first
        window = np.repeat(np.arange(len(counts)), counts)
        place = array[np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)]
        own = place < STRETCH  # those behind start in the next stretch, too
        places.append(place[own] + low)
        windows.append(window[own])
    return (np.concatenate(places), np.concatenate(windows)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
_FOUND_DDL = "struct<n_words: bigint, spans: array<struct<a: bigint, b: bigint>>, items: array<string>>"


def _shards(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[list[pa.RecordBatch], list[int], np.ndarray]]:
    """Whole batches, the first place of each document, and all their words with a 0 behind each document."""
    held, ids, sizes, size = [], [], [], 0
    end = np.zeros(1, np.int64)
    for batch in batches:
        at = 0
        for i, text in enumerate(batch.column("text")):
            data = (text.as_py() or "").encode()
            own = _numbered(data, block.numbers)
            ids += [own, end]
            sizes.append(len(own) + 1)
            size += len(data)
            if size >= SHARD:
                held.append(batch.slice(at, i + 1 - at))
                yield held, np.cumsum([0, *sizes]), np.concatenate(ids)
                held, ids, sizes, size, at = [], [], [], 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield held, np.cumsum([0, *sizes]), np.concatenate(ids)


def _scanned(shared):
    """Adds what one block of the benchmark shows to the findings of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for held, starts, ids in _shards(batches, block):
            place, window = occurrences(ids, block)
            reach = block.lengths[window]
            edges = np.bincount(place, minlength=len(ids) + 1) - np.bincount(place + reach, minlength=len(ids) + 1)
            covered = np.cumsum(edges)[: len(ids)] > 0
            doc = np.searchsorted(starts, place, side="right") - 1
            pairs = np.unique(doc * (len(block.starts) + 1) + window)
            seen, at = pairs // (len(block.starts) + 1), 0
            for batch in held:
                found = batch.column("found").to_pylist()
                for i in range(batch.num_rows):
                    low, high = int(starts[at]), int(starts[at + 1]) - 1
                    a, b = np.searchsorted(seen, [at, at + 1])
                    windows = pairs[a:b] % (len(block.starts) + 1)
                    spans, items = [], []
                    if b > a:
                        spans = _spans(covered[low:high])
                        who = np.unique(np.concatenate([block.owners[block.offsets[k] : block.offsets[k + 1]] for k in windows]))
                        items = [block.names[k] for k in who]
                    before = found[i]
                    if before is not None:
                        spans = _united([*((x["a"], x["b"]) for x in before["spans"]), *spans])
                        items = sorted({*before["items"], *items})
                    found[i] = {"n_words": high - low, "spans": [{"a": x, "b": y} for x, y in spans], "items": items}
                    at += 1
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(found, _FOUND)], names=["row", "text", "found"])

    return run


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(row, found) for every row of ``docs``: the row itself, and its number of words, the (a, b) stretches of words that
    are hit, and the ids of the items whose windows occur, in order."""
    spark = docs.sparkSession
    ship_package(spark)
    state = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.lit(None).cast(_FOUND_DDL).alias("found"))
    schema = f"row {dict(state.dtypes)['row']}, text string, found {_FOUND_DDL}"
    blocks = benchmark_blocks(benchmark)
    block = next(blocks, None) or block_of([])
    while block is not None:
        state = state.mapInArrow(_scanned(spark.sparkContext.broadcast(block)), schema)
        block = next(blocks, None)
        if block is not None:
            state = stage(state, "scanned")  # one block's arrays in memory at a time
    return state.select("row", "found")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window."""
    return scan_documents(docs, benchmark, text).where(F.size("found.spans") == 0).select("row.*")


def _longest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        query = np.flatnonzero(block.test)
        behind = np.flatnonzero(block.test == 0)
        length = behind[np.searchsorted(behind, query)] - query
        best: dict[int, tuple] = {}
        for held, starts, ids in _shards(batches, block):
            names = [x for batch in held for x in batch.column("id").to_pylist()]
            for low in range(0, len(ids), STRETCH):
                part = ids[low : low + 2 * STRETCH]  # matches may go on behind the stretch
                array = suffix_array(part, int(length.max(initial=1)))
                array = array[array < STRETCH]
                if not len(array):
                    continue
                place = _bound(part, array, block.test, query, length, behind=False)
                for near in (np.maximum(place - 1, 0), np.minimum(place, len(array) - 1)):
                    _, common = _ordered(part, array[near], block.test, query, length)
                    # The longest match of each item in this stretch.
                    order = np.lexsort((query, -common, block.item_of[query]))
                    items = block.item_of[query[order]]
                    for k in order[np.r_[True, items[1:] != items[:-1]]]:
                        if not common[k]:
                            continue
                        at = low + int(array[near[k]])
                        doc = int(np.searchsorted(starts, at, side="right")) - 1
                        found = (int(common[k]), int(block.word_at[query[k]]), names[doc], at - int(starts[doc]))
                        item = int(block.item_of[query[k]])
                        if item not in best or found[0] > best[item][0]:
                            best[item] = found
        rows = [(block.names[item], *found) for item, found in best.items()]
        yield pa.RecordBatch.from_pydict(
            {
                "item_id": pa.array([r[0] for r in rows], pa.string()),
                "words": pa.array([r[1] for r in rows], pa.int64()),
                "item_at": pa.array([r[2] for r in rows], pa.int64()),
                "doc_id": pa.array([r[3] for r in rows], pa.string()),
                "doc_at": pa.array([r[4] for r in rows], pa.int64()),
            }
        )

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, words, item_at, doc_id, doc_at): the longest verbatim match of every item that has one, and where it lies,
    counted in words from 0. Of equally long ones any is named. Ids are returned as text."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    schema = "item_id string, words bigint, item_at bigint, doc_id string, doc_at bigint"
    found = None
    for block in benchmark_blocks(benchmark):
        own = rows.mapInArrow(_longest(spark.sparkContext.broadcast(block)), schema)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("words", "item_at", "doc_id", "doc_at")).alias("best")
    return found.groupBy("item_id").agg(best).select("item_id", "best.*")
