"""Removal of repeated byte strings: every byte covered by a ``LENGTH``-byte string that starts anywhere else, too.

The work is cut in shards in which equal strings meet by themselves. Every string of LENGTH bytes is named by its
anchor, the smallest hash among its ``GRAM``-byte substrings; equal strings have equal anchors. Successive starts with
one anchor form a run, and the bytes that the strings of a run cover are its region. Regions are told apart by
128-bit hashes of their bytes, and counted before anything else moves:

* an anchor with a single region has no repeats unless the region is repeated, or holds its anchor several times;
* a repeated region is repeated at all its starts, whatever the number of its copies;
* an anchor with several different regions, or one that repeats its anchor, needs a comparison. Its distinct regions, one copy each, are dealt by
  anchor. Tasks put whole anchors together to shards of about ``SHARD`` bytes and build each shard's suffix array: the
  suffixes are sorted by their first 8 bytes, then groups of equals are refined by the ranks of the suffixes behind,
  tripling the depth until it is LENGTH. Starts of one rank are equal strings.
* an anchor whose distinct regions exceed ``HOT`` bytes is not gathered. Its strings are hashed one by one (128 bits),
  counted by partial aggregation and joined back, so it is split over all tasks.

The refinement stops at depth LENGTH, where equal ranks are common prefixes of LENGTH bytes, so no separate scan for
common prefixes is needed, and since anchors keep equal strings in one shard, suffix arrays of shards need no merging.

Strings are judged on the input and never cross documents. Defined results: a null text counts as empty; documents
under LENGTH bytes lose nothing; of equal texts of LENGTH bytes or more all bytes are removed. Repeated ids are told
apart by their texts, repeated rows are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import join_groups, text_of
from recordloom.session import ship_package, stage

LENGTH = 400
GRAM = 32
SHARD = 1 << 20
HOT = 1 << 19
#: Starts of a long text are taken in blocks of so many.
BLOCK = 1 << 18
#: Tasks take texts, and give rows, in batches of about so many bytes, however large Spark's Arrow batches are.
PIECE = 1 << 22
#: Runs in a batch.
RUNS = 1 << 15

_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    value = 1
    for i in range(n):
        out[i] = value
        value = value * base & _MASK
    return out


class Anchors:
    """Runs of starts with one anchor."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram, self.grams = length, gram, length - gram + 1
        self.up = _powers(_FACTOR, BLOCK + length)
        self.down = _powers(pow(_FACTOR, -1, 1 << 64), BLOCK + length)

    def hashes(self, octets: np.ndarray) -> np.ndarray:
        """A hash of the ``gram`` bytes from each place: differences of one running sum, brought to the same power."""
        sums = np.zeros(len(octets) + 1, np.uint64)
        np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * self.up[: len(octets)], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(octets) - self.gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def smallest(self, h: np.ndarray) -> np.ndarray:
        """The minimum of every ``grams`` neighbours, from running minima of blocks in both directions."""
        w = self.grams
        blocks = np.full(-(-len(h) // w) * w, np.uint64(_MASK))
        blocks[: len(h)] = h
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[: len(h) - w + 1], ahead[w - 1 : len(h)])

    def runs(self, octets: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
        """(start, number of starts, anchor, inner) of every run of a text, block by block.

        Equal strings have their anchors at the same place, so a run repeats itself only if its strings have the anchor
        at two places of the text: if it goes on (``inner``) after the first place has left the string.
        """
        for at in range(0, len(octets) - self.length + 1, BLOCK):
            h = self.hashes(octets[at : at + BLOCK + self.length - 1])
            anchors = self.smallest(h)
            first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
            sizes = np.diff(np.r_[first, len(anchors)])
            inner = [int(h[a : a + self.grams].argmin()) < n - 1 for a, n in zip(first.tolist(), sizes.tolist())]
            yield from zip((first + at).tolist(), sizes.tolist(), anchors[first].view(np.int64).tolist(), inner)


def repeated_starts(regions: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each region, whether the string at each of its starts is also at another start of these regions."""
    sizes = np.array([len(x) for x in regions])
    text = np.frombuffer(b"".join(regions) + bytes(length), np.uint8)
    n = int(sizes.sum())
    # Places and ranks take 32 bits where they fit, and what is no longer needed goes at once: a shard's memory is a multiple of n.
    kind = np.int32 if n + length < 1 << 31 else np.int64
    # Rank by the first 8 bytes.
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words <<= np.uint64(8)
        words |= text[i : n + i]
    order = np.argsort(words).astype(kind)
    words = words[order]
    rank, open_ = _ranked(words, order, np.zeros(n + 1, kind))
    del words, order
    depth = 8
    while depth < length and len(open_):
        # Ranks are below 2^21 in a shard of usual size, so three of them fit one number; else two do.
        deeper = min((3 if n + 1 < 1 << 21 else 2) * depth, length)
        steps = [depth, deeper - depth] if deeper > 2 * depth else [deeper - depth]
        key = rank[open_].astype(np.int64)
        for step in steps:
            key *= n + 1
            key += rank[np.minimum(open_ + step, n)]
        order = np.argsort(key).astype(kind)
        key, open_ = key[order], open_[order]
        rank, open_ = _refined(key, open_, rank)
        del key, order
        depth = deeper
    ends = np.cumsum(sizes)
    found = np.zeros(n, bool)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        found[end - size : max(end - size, end - length + 1)] = True
    ranks = rank[:n][found]
    counts = np.bincount(ranks, minlength=n + 1)
    found[found] = counts[ranks] > 1
    return [found[end - size : end - length + 1] for end, size in zip(ends.tolist(), sizes.tolist())]


def _ranked(keys: np.ndarray, order: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First ranks: a suffix's rank is the place of the first of its equals, counted from 1; 0 lies behind the text."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    place = np.maximum.accumulate(np.where(first, np.arange(len(keys), dtype=rank.dtype), 0))
    rank[order] = place + 1
    alone = first & np.r_[first[1:], True] if len(keys) else first
    return rank, order[~alone]


def _refined(keys: np.ndarray, members: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of the sorted ``members`` of open groups; those that stand alone are closed."""
    first = np.r_[True, keys[1:] != keys[:-1]]
    old = rank[members]
    group = np.r_[True, old[1:] != old[:-1]]
    index = np.arange(len(keys), dtype=rank.dtype)
    group_start = np.maximum.accumulate(np.where(group, index, 0))
    place = np.maximum.accumulate(np.where(first, index, 0))
    rank[members] = old + (place - group_start)
    alone = first & np.r_[first[1:], True]
    return rank, members[~alone]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that (start, stop) intervals cover."""
    out: list[list[int]] = []
    for start, stop in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _spans_of(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2])]


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of at most PIECE bytes of ``column``, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends):
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + PIECE, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, text in enumerate(batch.column("text")):
            data = text.as_py().encode()
            for at, n, value, again in finder.runs(np.frombuffer(data, np.uint8)):
                yield i, at, n, value, again, xxh3_128_digest(data[at : at + n + LENGTH - 1])

    finder = Anchors()
    for batch in _pieces(batches, "text"):
        found = rows(batch)
        while some := list(islice(found, RUNS)):
            origin, start, size, anchor, inner, region = zip(*some)
            halves = np.frombuffer(b"".join(region), "<i8").reshape(-1, 2)
            own = pa.array(origin, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(own),
                    batch.column("key").take(own),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(anchor, pa.int64()),
                    pa.array(inner, pa.bool_()),
                    pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["a", "b"]),
                ],
                names=["doc_id", "key", "start", "n_starts", "anchor", "inner", "region"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted regions of each text."""

    def regions() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "anchor": pa.array([w["anchor"] for w in held], pa.int64()),
                "hot": pa.array([w["hot"] for w in held], pa.bool_()),
                "region": pa.array([w["region"] for w in held], pa.struct([("a", pa.int64()), ("b", pa.int64())])),
                "bytes": pa.array(cut, pa.binary()),
            }
        )

    held: list[dict] = []
    cut: list[bytes] = []
    size = 0
    for batch in _pieces(batches, "text"):
        for text, wanted in zip(batch.column("text"), batch.column("wanted")):
            data = text.as_py().encode()
            for w in wanted.as_py():
                held.append(w)
                cut.append(data[w["start"] : w["start"] + w["n_starts"] + LENGTH - 1])
                size += len(cut[-1])
                if size >= PIECE:
                    yield regions()
                    held, cut, size = [], [], 0
    if held:
        yield regions()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated starts of regions that come sorted by anchor, in shards of whole anchors."""

    def judged() -> pa.RecordBatch:
        spans = [_spans_of(flags) for flags in repeated_starts([x for _, x in held.values()])]
        return pa.RecordBatch.from_pydict(
            {
                "region": pa.array([r for r, _ in held.values()], pa.struct([("a", pa.int64()), ("b", pa.int64())])),
                "spans": pa.array(spans, _SPANS),
            }
        )

    held: dict = {}
    size, last = 0, None
    for batch in _pieces(batches, "bytes"):
        for anchor, region, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "region", "bytes"))):
            if anchor != last and size >= SHARD:
                yield judged()
                held, size = {}, 0
            last = anchor
            name = (region["a"], region["b"])
            if name not in held:  # repeated rows deliver a region twice
                held[name] = (region, data)
                size += len(data)
    if held:
        yield judged()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, at, string): the hash of every string of a hot anchor's regions."""
    from xxhash import xxh3_128_digest

    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    for batch in _pieces(batches, "bytes"):
        for region, data in zip(batch.column("region").to_pylist(), batch.column("bytes").to_pylist()):
            n = len(data) - LENGTH + 1
            for low in range(0, n, BLOCK):
                high = min(n, low + BLOCK)
                halves = np.frombuffer(b"".join(xxh3_128_digest(data[i : i + LENGTH]) for i in range(low, high)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([region] * (high - low), pair),
                        pa.array(range(low, high), pa.int64()),
                        pa.StructArray.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["a", "b"]),
                    ],
                    names=["region", "at", "string"],
                )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, "text"):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, covered in zip(batch.column("text"), batch.column("covered").to_pylist()):
            data = text.as_py().encode()
            spans = merged([(x["a"], min(x["b"], len(data))) for x in covered or []])
            edges = [0, *(edge for span in spans for edge in span), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            n_bytes.append(len(data))
            n_removed.append(sum(b - a for a, b in spans))
            n_spans.append(len(spans))
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


PAIR = "struct<a: bigint, b: bigint>"


def covered_bytes(texts: DataFrame) -> DataFrame:
    """(key, covered, n): for every text of ``texts`` (doc_id, key, text) with repeats, the (a, b) byte intervals that
    repeated strings cover, and the number of rows with that text. Intervals may touch and overlap."""
    long = texts.where(F.octet_length("text") >= LENGTH)
    copies = stage(long.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "copied_texts")
    runs = stage(
        long.mapInArrow(_runs, f"doc_id long, key {PAIR}, start long, n_starts long, anchor long, inner boolean, region {PAIR}"), "anchor_runs"
    )
    regions = stage(
        runs.groupBy("region").agg(
            F.min("anchor").alias("anchor"), F.bool_or("inner").alias("inner"), F.count("*").alias("n"), F.min(F.struct("key", "doc_id", "start", "n_starts")).alias("at")
        ),
        "regions",
    )
    size = F.col("at.n_starts") + LENGTH - 1
    by_anchor = regions.groupBy("anchor").agg(F.count("*").alias("n_regions"), F.sum(size).alias("size"), F.bool_or("inner").alias("any_inner"))
    anchors = stage(by_anchor.where("n_regions > 1 or any_inner"), "mixed_anchors")
    mixed = join_groups(regions, anchors, "anchor", "n_regions", regions.count()).withColumn("hot", F.col("size") > HOT)
    wanted = mixed.groupBy("at.key", "at.doc_id").agg(
        F.collect_list(F.struct("anchor", "hot", "region", "at.start", "at.n_starts")).alias("wanted")
    )
    # Ids and texts together are only repeated by repeated rows, so this join has no hot key.
    found = long.alias("t").join(wanted.alias("w"), F.expr("t.key = w.key and t.doc_id <=> w.doc_id")).select("text", "wanted")
    cut = stage(found.mapInArrow(_cut, f"anchor long, hot boolean, region {PAIR}, bytes binary"), "region_bytes")

    shards = cut.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "region").select("anchor", "region", "bytes")
    compared = shards.mapInArrow(_compared, f"region {PAIR}, spans array<{PAIR}>")
    strings = stage(
        cut.where("hot").dropDuplicates(["region"]).select("region", "bytes").mapInArrow(_strings, f"region {PAIR}, at long, string {PAIR}"),
        "hot_strings",
    )
    repeated = stage(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1"), "repeated_strings")
    starts = join_groups(strings, repeated, "string", "n", strings.count()).groupBy("region")
    # Neighbouring starts make one span: it begins where none lies before and ends where none follows.
    split = (
        starts.agg(F.sort_array(F.collect_list("at")).alias("ats"))
        .withColumn("firsts", F.expr("filter(ats, (x, i) -> coalesce(get(ats, i - 1) < x - 1, true))"))
        .withColumn("lasts", F.expr("filter(ats, (x, i) -> coalesce(get(ats, i + 1) > x + 1, true))"))
        .select("region", F.expr("zip_with(firsts, lasts, (a, b) -> struct(a as a, b + 1 as b))").alias("spans"))
    )
    whole = regions.where("n > 1").select("region", "n", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("at.n_starts").alias("b"))).alias("spans"))
    single = compared.unionByName(split).where(F.size("spans") > 0).join(regions.where("n = 1").select("region", "n"), "region")
    verdicts = stage(whole.unionByName(single.select("region", "n", "spans")), "verdicts")

    intervals = (
        join_groups(runs, verdicts, "region", "n", runs.count())
        .select("key", "start", F.explode("spans").alias("span"))
        .select("key", F.struct((F.col("start") + F.col("span.a")).alias("a"), (F.col("start") + F.col("span.b") + LENGTH - 1).alias("b")).alias("interval"))
        .groupBy("key")
        .agg(F.collect_set("interval").alias("covered"))
    )
    everything = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(1 << 62).alias("b")))
    return intervals.join(copies, "key", "left").select(
        "key", F.when(F.col("n").isNotNull(), everything).otherwise(F.col("covered")).alias("covered"), F.coalesce("n", F.lit(1)).alias("n")
    )


def drop_repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of ``docs`` (doc_id, text); kept is the bytes left."""
    ship_package(docs.sparkSession)
    text = text_of("text")
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text.alias("text"))
    covered = stage(covered_bytes(texts), "covered")
    met = join_groups(texts, covered, "key", "n", docs.count(), "left").select("doc_id", "text", "covered")
    return met.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
