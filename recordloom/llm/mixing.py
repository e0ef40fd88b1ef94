"""Mixing sources to target weights: each document is repeated floor(rate) times, plus once by a seeded draw.

Sizes are counted per row and added up per source before anything is shuffled. Targets are weights times a level that
is found by a few aggregations over the table of sources: a source whose share would exceed ``MAX_REPEATS`` times its
size is held there, and the rest is shared again by weight until none is above.

The draws of a document are eight numbers cut from one SHA-256 of its id; each source uses the one of the eight seeds
that brings its taken words nearest to its target (the first of equals), so reruns agree.

Defined results: a null text has size 0; a null source is a source of its own and comes last; documents without an id
share one draw; repeated rows get the same copies; an empty table gives an empty result. Sources of size 0 have
target 0 and take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import SPACE, join_groups, text_of, with_position
from recordloom.session import stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEEDS = 8
_WHOLE = "decimal(19,0)"


def size_of(text: str = "text") -> Column:
    """The number of words of a text."""
    return F.regexp_count(text_of(text), F.lit(f"[^{SPACE[1:]}+")).cast("long")


def source_key(source: str = "source") -> Column:
    """A key that sorts sources by code point, null last."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def _draw(doc_id: str, seed: int) -> Column:
    """The document's draw number ``seed``, in [0, 1)."""
    digest = F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * seed + 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _copies(doc_id: str, seed: int) -> Column:
    return F.floor("rate") + (F.lit(1) * (_draw(doc_id, seed) < F.col("rate") - F.floor("rate")).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(key, source_size, n_docs, target, rate) of every source of ``sizes`` (key, size)."""
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stage(with_position(stage(totals, "sources"), "key", "place").withColumn("weight", weight), "weighted")
    cap = F.col("source_size") * MAX_REPEATS

    def exceeds(words: int, weight: int) -> Column:  # products of two such numbers pass 32 and 64 bits
        return cap.cast(_WHOLE) * F.lit(weight).cast(_WHOLE) < F.col("weight").cast(_WHOLE) * F.lit(words).cast(_WHOLE)

    free_words = free_weight = None
    while True:  # the level only rises, and every round holds at least one more source
        above = F.lit(False) if free_words is None else exceeds(free_words, free_weight)
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        words, weight_left = (row["all"] or 0) - row["held"], row["weight"]
        if (words, weight_left) == (free_words, free_weight):
            break
        free_words, free_weight = words, weight_left
    share = F.col("weight") * F.lit(float(free_words)) / F.lit(float(free_weight or 1))
    held = exceeds(free_words, free_weight or 1)
    target = F.when(held, cap.cast("double")).otherwise(share)
    rate = F.when(held, float(MAX_REPEATS)).when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(MAX_REPEATS))))
    return sources.select("key", "source_size", "n_docs", target.alias("target"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def plan_mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS):
    """(sizes, sources): the written table (doc_id, key, size) and the written table of sources with rate and seed."""
    sizes = stage(docs.select(F.col(doc_id).alias("doc_id"), source_key(source).alias("key"), size_of(text).alias("size")), "sizes")
    sources = stage(source_targets(sizes, weights), "targets")
    rated = join_groups(sizes, sources, "key", "n_docs", sizes.count())
    sums = rated.groupBy("key", "target").agg(*(F.sum(F.col("size") * _copies("doc_id", s)).alias(f"taken{s}") for s in range(SEEDS)))
    gaps = [F.abs(F.col(f"taken{s}") - F.col("target")) for s in range(SEEDS)]
    seed = F.array_position(F.array(*gaps), F.array_min(F.array(*gaps))) - 1
    return sizes, stage(sources.join(sums.select("key", seed.cast("int").alias("seed")), "key"), "seeded")


def with_copies(sizes: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """``sizes`` joined with its source, and ``copies``, the number of times that a document is taken."""
    chosen = F.element_at(F.array(*(_copies("doc_id", s) for s in range(SEEDS))), F.col("seed") + 1)
    return join_groups(sizes, sources, "key", "n_docs", total).withColumn("copies", chosen)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS) -> DataFrame:
    """The mixture: every row of ``docs`` as many times as it is taken, with its own columns only."""
    sizes, sources = plan_mixture(docs, doc_id, text, source, weights)
    rows = docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("doc_id"), source_key(source).alias("key"))
    return (
        with_copies(rows, sources, sizes.count())
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc.*")
    )
