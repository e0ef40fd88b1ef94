"""Helpers shared by the corpus operators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
#: A group holding more than one row in HOT_SHARE is hot. There can be no more than HOT_SHARE of them.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: longest runs without ASCII white space."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``groups`` (one row per ``key``; ``size``: its number of rows; ``total``: of all).

    Hot groups would send a large share of the rows to one task. At most HOT_SHARE groups can be hot, so those are
    broadcast and their rows stay where they are; the other groups are small and take the ordinary join. Null keys
    do not match. Both inputs should be written tables, as each is read twice.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    cold = groups.where(F.col(size) * HOT_SHARE <= total)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return rows.join(hot, key).unionByName(rest)


def with_position(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` sorted by its unique ``key`` over all tasks, with each row's place in that order (0, 1, ...).

    Rows are dealt by range and sorted in their tasks; only the row count of each task is gathered. The result
    holds a nondeterministic expression: write it before using it twice.
    """
    from recordloom.session import stage

    low = (1 << 33) - 1  # Spark numbers the rows of a task in the low 33 bits
    ranged = stage(
        df.repartitionByRange(F.col(key).asc())
        .sortWithinPartitions(key)
        .withColumn("_n", F.monotonically_increasing_id()),
        "ranged",
    ).withColumns({"_task": F.shiftright("_n", 33), "_n": F.col("_n").bitwiseAND(F.lit(low))})
    counts = sorted((r["_task"], r["n"]) for r in ranged.groupBy("_task").agg(F.count("*").alias("n")).collect())
    starts, seen = [], 0
    for task, n in counts:
        starts.append((task, seen))
        seen += n
    offsets = df.sparkSession.createDataFrame(starts, "_task long, _start long")
    return ranged.join(F.broadcast(offsets), "_task").withColumn(name, F.col("_start") + F.col("_n")).drop("_task", "_n", "_start")


# --- labelled samples and texts in Python ------------------------------------------------------------

#: The texts of a labelled sample are dealt to so many tasks.
SAMPLE_TASKS = 64
#: Words are taken from texts in blocks of about so many code points, to bound the memory of a task.
BLOCK_CHARS = 1 << 20


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


@dataclass(frozen=True)
class Sample:
    """Labelled rows (doc_id, label, text: whole) and the number of all usable labels of 0 and of 1 that have a document."""

    rows: DataFrame
    totals: tuple[int, int]

    def weights(self, labels: np.ndarray) -> np.ndarray:
        """A weight for each of the sample's ``labels``: each class weighs its share of all usable labels, the mean is 1."""
        drawn = np.array([np.sum(labels == y) for y in (0, 1)], float)
        total = np.array(self.totals, float)
        return (total / np.maximum(drawn, 1) * len(labels) / max(total.sum(), 1))[labels.astype(int)]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], usable: Column) -> Sample:
    """At most ``per_class`` documents labelled 0 and 1, those with the smallest hashed ids, written as a table.

    Only labels that meet ``usable`` (a condition on doc_id) and have a document are looked at. The chosen ids are at
    most sum(per_class) rows, so they are broadcast; of rows that share an id one text is used. Texts are whole and
    stay in the table: what is learned from them is computed in tasks.
    """
    from recordloom.session import stage

    known = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = stage(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "usable_labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(n) for y, n in enumerate(per_class)]
    rows = (
        docs.select("doc_id", text_of("text").alias("text"))
        .join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
        .repartition(SAMPLE_TASKS, "doc_id")
        .groupBy("doc_id", F.col("label").cast("int").alias("label"))
        .agg(F.min("text").alias("text"))
    )
    return Sample(stage(rows, "labelled_texts"), (counts.get(0, 0), counts.get(1, 0)))


def word_blocks(text: str):
    """The words of a text in lists, cut at white space after about BLOCK_CHARS code points."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK_CHARS)
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def byte_words(data: bytes, table: bytes):
    """The words of UTF-8 bytes, after ``table`` has turned what divides words into spaces, in lists of about BLOCK_CHARS bytes."""
    data = data.translate(table)
    at = 0
    while at < len(data):
        end = at + BLOCK_CHARS
        if end < len(data):
            cut = data.find(b" ", end)
            end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end
