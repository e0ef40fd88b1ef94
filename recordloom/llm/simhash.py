"""SimHash near-deduplication: fingerprints, pigeonhole blocks, verified links, connected components.

A fingerprint has 64 bits; each is 1 if more than half of the text's word shingles have it set in their hash. Two
fingerprints link if they differ in at most ``MAX_BITS`` = 4 bits. They are cut in 6 or more blocks; four differing
bits touch four blocks at most, so linked fingerprints agree in all blocks but four. Fingerprints that agree in so many
blocks meet and are compared. Any number of blocks finds the same links; ``block_count`` takes as many as keep
``MEETING`` fingerprints or fewer to a meeting: 6 (15 keys of 20 bits or more for each fingerprint) up to 67 million
distinct fingerprints, 7 (35 keys of 27 bits) up to 8.6 thousand million, then 8 (70 keys of 32 bits).

Exact copies share a fingerprint and meet as one. A pair of blocks that many fingerprints share is cut in chunks of
``CHUNK`` fingerprints, and every two chunks meet in a task of their own, so no task holds more than two chunks. A
task reports a spanning forest of the links that it finds, never all pairs; the components are those of all links.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is linked like any other.
The component's name is its smallest id; rows without an id belong to a component but never name it, a component
without any id is named null. Rows may repeat. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from recordloom.llm.common import join_groups
from recordloom.llm.components import components
from recordloom.session import ship_package, stage

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Unrelated fingerprints that may meet, on average.
MEETING = 64
CHUNK = 2048
#: Shingles of long texts are hashed in runs of this length, to bound a task's memory.
RUN = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    tokens = text.encode().translate(_LOWER).split()  # bytes split at ASCII white space
    if not tokens:
        return 0
    line = b" ".join(tokens)
    if len(tokens) <= shingle_words:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - shingle_words + 1].tolist()
    last = ends[shingle_words - 1 :].tolist()
    n, counts = len(first), np.zeros(64, np.int64)
    for at in range(0, n, RUN):
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(first[at : at + RUN], last[at : at + RUN])]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(bit) for bit in np.flatnonzero(2 * counts > n)))


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    """The fingerprints of whole texts, their 64 bits as longs; a null text counts as empty."""
    return pd.Series(np.array([fingerprint(text or "") for text in texts], dtype=np.uint64).view(np.int64))


def _edges(blocks: int) -> list[int]:
    return [64 * i // blocks for i in range(blocks + 1)]


def block_count(fingerprints: int) -> int:
    """The fewest blocks whose shortest key keeps a meeting of ``fingerprints`` different ones to MEETING on average."""
    blocks = MAX_BITS + 2
    while blocks < 16:
        edges = _edges(blocks)
        shortest = sum(sorted(b - a for a, b in zip(edges, edges[1:]))[: blocks - MAX_BITS])
        if fingerprints <= MEETING << shortest:
            break
        blocks += 1
    return blocks


def block_keys(blocks: int) -> Column:
    """An array of (combination, key): the bits of all but MAX_BITS of the fingerprint's ``blocks``, in every choice."""
    edges = _edges(blocks)
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - MAX_BITS)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("combination"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: breadth first, one row of comparisons a node."""
    values, left, out = fps.view(np.uint64), np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            node = queue.pop()
            others = np.flatnonzero(left)
            near = others[_popcount(values[others] ^ values[node]) <= max_bits]
            left[near] = False
            queue += near.tolist()
            out += [(int(fps[node]), int(fps[k])) for k in near]
    return out


def _linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of every run of equal (combination, key, i, j) in a task's sorted rows; a run may cross frames."""
    names = ["combination", "key", "i", "j"]
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        keys = frame[names].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(frame) else np.array([], int)
        held = frame.iloc[starts[-1] :] if len(starts) else None
        yield _links_of(frame["fp"].to_numpy()[: starts[-1]] if len(starts) else np.array([], np.int64), starts)
    if held is not None:
        yield _links_of(held["fp"].to_numpy(), np.array([0, len(held)]))


def _links_of(fps: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
    """Spanning links of the runs of ``fps`` between successive ``starts``. Runs of two, nearly all, go together."""
    sizes = np.diff(starts)
    twos = starts[:-1][sizes == 2]
    a, b = fps[twos], fps[twos + 1]
    near = _popcount((a ^ b).view(np.uint64)) <= MAX_BITS
    more = [pair for at, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2]) for pair in forest(fps[at : at + n])]
    extra = np.array(more, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": np.r_[a[near], extra[:, 0]], "b": np.r_[b[near], extra[:, 1]]})


def links(distinct: DataFrame, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """(a, b): links between the fingerprints of ``distinct`` (fp) that connect whatever is connected."""
    blocks = blocks or block_count(distinct.count())
    keyed = stage(distinct.select("fp", F.explode(block_keys(blocks)).alias("at")).select("fp", "at.*"), "block_keys")
    shared = keyed.groupBy("combination", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(shared.withColumn("at", F.struct("combination", "key")), "shared_blocks")
    met = join_groups(keyed.withColumn("at", F.struct("combination", "key")).drop("combination", "key"), shared.drop("combination", "key"), "at", "n", keyed.count())
    # Two chunks i <= j meet; a block of one chunk meets itself as (0, 0).
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    meetings = F.expr("transform(sequence(0, chunks - 1), k -> struct(least(k, own) as i, greatest(k, own) as j))")
    dealt = (
        met.withColumn("chunks", chunks)
        .withColumn("own", own)
        .select("fp", "at.*", F.explode(meetings).alias("pair"))
        .select("combination", "key", "pair.*", "fp")
        .repartition("combination", "key", "i", "j")
        .sortWithinPartitions("combination", "key", "i", "j", "fp")
    )
    return dealt.mapInPandas(_linked, "a long, b long")


def fingerprint_classes(marked: DataFrame) -> DataFrame:
    """(fp, n, component_id, first) for every fingerprint of the written table ``marked`` (doc_id, fp, row).

    n counts the rows of the fingerprint; ``first`` is the smallest (no id, id, row) of the whole component.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    distinct = stage(marked.groupBy("fp").agg(F.min(rank).alias("first"), F.count("*").alias("n")), "distinct_fingerprints")
    roots = stage(components(links(distinct)), "roots")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "named_fingerprints")
    names = stage(named.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("members")), "components")
    met = join_groups(named.drop("first"), names, "root", "members", named.count())
    return stage(met.select("fp", "n", F.col("first.doc_id").alias("component_id"), "first"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    marked = stage(docs.select("doc_id", fingerprint_of("text").alias("fp")).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    return join_groups(marked, fingerprint_classes(marked), "fp", "n", marked.count()).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first row (by id, then place) of every component, with its own columns.

    The rows are written once with fingerprint and row number, so that every later step sees the same numbers.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", fingerprint_of("text").alias("fp"))
    marked = stage(rows.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    first = fingerprint_classes(marked.select("doc_id", "fp", "row")).select("first.row").distinct()
    return marked.join(first, "row", "left_semi").select("doc.*")
