"""Best-fit packing: token sequences of a fixed length from whole documents, with as little padding as possible.

A document's tokens end with ``END``. Documents longer than a sequence are cut into full pieces; what is left over
makes the first piece. Full pieces are sequences already. The others are dealt evenly, by a row number, to shards of
about ``SHARD_PIECES`` pieces, and every shard is packed by best-fit decreasing: pieces by falling length, each into
the fullest sequence that still has room. A segment tree over the capacities 0 ... ``LENGTH`` says which capacities
have open sequences, so the tightest one is found in logarithmic time. A shard wastes about one sequence, whatever
its size, so cutting the work in shards costs about one sequence in twenty thousand.

Token ids stay in the written table of pieces (unsigned 32-bit, little-endian); only row numbers and lengths are
shuffled and packed.

Defined results: a null text counts as empty and is one piece that holds ``END`` alone; an added token of the
vocabulary (``<|endoftext|>``) in a text is that token, as its library reads it; repeated rows and repeated ids are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import ship_package, stage

LENGTH = 1024
END = 2
SHARD_PIECES = 65_536
VOCABULARY = "byte_bpe_50k"
#: Documents are encoded in groups of so many characters at most, to bound a task's memory.
BATCH_CHARS = 4_000_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a public vocabulary: text to token ids, as the JSON file of that name gives them.

    The ranks file is the same vocabulary and several times as fast to apply, but it has no added tokens, and its
    library gives up on runs of very many spaces; such texts take the JSON file itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    added = [token.content for token in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if not any(content in text for content in added):
            try:
                return encoding.encode_ordinary(text)
            except BaseException as error:  # a Rust panic is no Exception
                if type(error).__name__ != "PanicException":
                    raise
        return exact.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: full ones, after one with the remainder."""
    first = n % length or length
    starts = [0, *range(first, n, length)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def token_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text), with their token ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = np.array([*encode(text), END], dtype="<u4")
                rows += [(doc_id, i, a, n, ids[a : a + n].tobytes()) for i, (a, n) in enumerate(cut(len(ids), length))]
                held += len(text)
                if held > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


class OpenSequences:
    """Open sequences by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)  # the number of open sequences below each node
        self.at: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.at[capacity].append(sequence)
        self._count(capacity, 1)

    def _count(self, capacity: int, change: int) -> None:
        node = self.leaves + capacity
        while node:
            self.tree[node] += change
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the sequence with the least capacity that is at least ``need``: (capacity, sequence)."""
        tree, node = self.tree, self.leaves + need
        if not tree[node]:
            while node & 1 or not tree[node + 1]:  # climb until the right neighbour holds something
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._count(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, by best-fit decreasing; equal lengths in the order given."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room, made = OpenSequences(length), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = room.tightest(need)
        if found is None:
            found, made = (length, made), made + 1
        capacity, at = found
        sequence[i], offset[i] = at, length - capacity
        if capacity > need:
            room.add(capacity - need, at)
    return sequence, offset


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of ``docs`` (doc_id, text)."""
    pieces = stage(token_pieces(docs, length, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < length)
    shards = max(1, math.ceil(short.count() / shard_pieces))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)  # a shard's rows arrive in any order
        sequence, offset = best_fit(rows["length"].to_numpy(), length)
        # Even numbers are for packed sequences: the shard in the high bits, the place in the shard below.
        ids = (rows["shard"].to_numpy().astype(np.int64) << 32 | sequence) << 1
        return pd.DataFrame({"row": rows["row"], "sequence_id": ids, "offset": offset})

    layout = (
        short.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
        .groupBy("shard")
        .applyInPandas(packed, "row long, sequence_id long, offset long")
    )
    full = pieces.where(F.col("length") == length).withColumns(
        {"sequence_id": F.shiftleft("row", 1) + 1, "offset": F.lit(0).cast("long")}
    )
    return full.unionByName(short.join(layout, "row")).drop("row")
