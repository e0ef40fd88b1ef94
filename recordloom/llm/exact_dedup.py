"""Exact deduplication in two passes over a Bloom filter, with DataFrame operations only.

The first pass counts, for every bit of the filter, how many rows set it (one partial aggregation over bit positions)
and keeps the bits that more than one row sets. A row whose bits are not all kept is the only one of its text: it
passes straight through. The second pass shuffles what is left, 40 bytes a row, and compares full hashes.

The hashes are cut into ranges of at most ``rows_per_range`` rows, each with a filter of its own, so that a filter's
size is fixed: at most FILTER_BITS / 64 words of 16 bytes are broadcast at a time, whatever the input's size.

Defined results: a null text is empty; texts are equal if they are after every run of ASCII white space has become
one space. Of equal texts the row with the smallest id stays, rows without an id come last; of rows that agree in
text and id exactly one stays. An empty table gives an empty result. Further columns are kept as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import SPACE, join_groups, text_of
from recordloom.session import stage

FILTER_BITS = 1 << 26
#: Bits per row of a range and hash functions: about one unrepeated row in eighty passes the filter.
BITS_PER_ROW = 16
HASHES = 2


def text_hash(text: str = "text") -> Column:
    """SHA-256 (binary) of the text after every run of ASCII white space has become one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), f"{SPACE}+", " "), 256))


def _bits(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), "hash"), F.lit(bits)) for i in range(HASHES)]


def repeated_bits(hashes: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(word, mask): the filter's bits that at least two rows of ``hashes`` set, 64 to a row."""
    return (
        hashes.select(F.explode(F.array(*_bits(bits))).alias("bit"))
        .groupBy("bit")
        .count()
        .where("count > 1")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    )


def maybe_repeated(hashes: DataFrame, words: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``hashes`` with ``maybe``: false where the filter rules out an equal row. ``words`` has at most bits / 64 rows."""
    out, tests = hashes, []
    for i, bit in enumerate(_bits(bits)):
        word = F.broadcast(words.select(F.col("word").alias(f"word{i}"), F.col("mask").alias(f"mask{i}")))
        out = out.withColumn(f"bit{i}", bit).withColumn(f"word{i}", F.shiftright(f"bit{i}", 6)).join(word, f"word{i}", "left")
        tests.append(F.expr(f"coalesce(mask{i} & shiftleft(1L, cast(bit{i} & 63 as int)), 0L) <> 0"))
    return out.select(*hashes.columns, (tests[0] & tests[1]).alias("maybe"))


def _rank(doc_id: str) -> Column:
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col("row").alias("row"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, hash, keep_id, group_size, kept), one row for each row of ``docs``."""
    # The row number is written with the hash, so it never changes afterwards.
    hashes = stage(
        docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("hash"), F.monotonically_increasing_id().alias("row")),
        "text_hashes",
    )
    total = hashes.count()
    ranges = max(1, math.ceil(total * BITS_PER_ROW / bits))
    flagged = None
    if ranges > 1:
        path = stage(hashes.withColumn("range", F.pmod(F.xxhash64(F.lit("range"), "hash"), F.lit(ranges))), "hash_ranges", "range")
    for part in range(ranges):
        own = path.where(F.col("range") == part).drop("range") if ranges > 1 else hashes
        tested = stage(maybe_repeated(own, stage(repeated_bits(own, bits), "filter"), bits), "flagged")
        flagged = tested if flagged is None else flagged.unionByName(tested)

    candidates = flagged.where("maybe").drop("maybe")
    groups = stage(
        candidates.groupBy("hash").agg(F.min(_rank("doc_id")).alias("first"), F.count("*").alias("group_size")), "hash_groups"
    )
    compared = join_groups(candidates, groups, "hash", "group_size", total).select(
        "doc_id", "hash", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept")
    )
    alone = flagged.where("not maybe").select(
        "doc_id", "hash", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    return alone.unionByName(compared)


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay.

    The decisions are a list of (hash, id) for repeated texts. Only rows that the filter of repeated hashes lets through
    shuffle to meet it (all of them, once the list outgrows the filter); the others pass straight through.
    """
    decisions = stage(exact_duplicates(docs, doc_id, text, bits), "decisions").where("group_size > 1")
    status = stage(
        decisions.groupBy("hash", F.col("doc_id").alias("id")).agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n")),
        "repeated_rows",
    )
    words = stage(repeated_bits(decisions.select("hash"), bits), "filter")
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("row_id"), text_hash(text).alias("hash"))
    rows = maybe_repeated(rows, words, bits)
    met = (
        rows.where("maybe")
        .alias("r")
        .join(status.alias("s"), F.expr("r.hash = s.hash and r.row_id <=> s.id"), "left")
        .select("doc", "row_id", "r.hash", "stays", "n")
    )
    out = rows.where("not maybe").select("doc.*").unionByName(met.where("stays is null or (stays and n = 1)").select("doc.*"))
    if not status.where("stays and n > 1").isEmpty():  # rows that agree in id and text: one of them
        out = out.unionByName(met.where("stays and n > 1").dropDuplicates(["hash", "row_id"]).select("doc.*"))
    return out
