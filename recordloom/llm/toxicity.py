"""Toxicity by compression distance: windows of a text compressed with a toxic and with an ordinary dictionary.

Both zstandard dictionaries are made from a bounded sample of labelled documents, whose whole texts are worked on in
tasks. The ordinary one is trained on ordinary texts, of which those over ``CONDENSED`` bytes are first
condensed by a dictionary trained on all their words. The toxic one holds the same ordinary text, with a part of it replaced by the segments of
words that set toxic texts apart: those whose strings of ``GRAMS`` bytes occur in far more toxic than ordinary documents,
the commonest ones last, where references are cheapest. What ordinary text both dictionaries know then costs the
same in both, and the difference of the two lengths shows the rest.

Every window of ``WORDS`` words, ``STEP`` words apart, is compressed twice without headers. A document is described
by the shares of its windows that the toxic dictionary shortens by at least 2, 3, ... bytes and the mean gain, as
logarithms; a logistic model over these calibrates them to a score. It is fitted on the same sample, each class
weighted to its share of all usable labels, so that a score means the same whatever part of the labels is sampled.

Defined results: a null or empty text has no window and gets the score of one that shows nothing; without labels of
both kinds the score is the share of toxic labels with one observation of each kind added. Repeated rows score alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from recordloom.llm.common import Sample, labelled_sample, word_blocks
from recordloom.session import ship_package

#: The most (ordinary, toxic) labelled documents used for fitting.
SAMPLE = (4000, 1500)
WORDS, STEP = 6, 3
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
#: Lengths in bytes of the strings that are counted.
GRAMS = (5, 8)
#: A string sets toxic texts apart if its share of them is RATIO times that of ordinary ones, and if the likelihood
#: ratio statistic of the two counts is at least EVIDENCE, which chance does not reach among a million strings.
RATIO, EVIDENCE = 4, 24
GAINS = (2, 3, 4, 5, 6)
#: Added to every share before its logarithm is taken.
FLOOR = 0.01
#: A training text is condensed to so many bytes, block by block.
CONDENSED = 2_048
#: The most distinguishing strings that are looked for in toxic texts.
STRINGS = 1 << 20


def windows(text: str) -> Iterator[bytes]:
    """Overlapping windows of lower-case words over the whole text; a short text is one window."""
    held: list[bytes] = []
    any_yet = False
    for block in word_blocks(text):
        held += [word.lower().encode() for word in block]
        at = 0
        while at + WORDS <= len(held):
            any_yet = True
            yield b" " + b" ".join(held[at : at + WORDS]) + b" "
            at += STEP
        held = held[at:]
    # What the last full window has covered already are the first WORDS - STEP words.
    if held and (not any_yet or len(held) > WORDS - STEP):
        yield b" " + b" ".join(held) + b" "


def _compressor(content: bytes):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def features(self) -> callable:
        ordinary, toxic = _compressor(self.ordinary).compress, _compressor(self.toxic).compress

        def of(text: str) -> np.ndarray:
            gains = Counter(len(ordinary(w)) - len(toxic(w)) for w in windows(text))
            n = sum(gains.values()) + STEP
            above = [sum(c for gain, c in gains.items() if gain >= k) / n for k in GAINS]
            mean = sum(gain * c for gain, c in gains.items() if gain > 0) / n
            return np.log(np.array([mean, *above]) + FLOOR)

        return of

    def score(self, features: np.ndarray) -> float:
        z = float(np.dot((features - self.mean) / self.scale, self.weights[:-1])) + self.weights[-1]
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def _octets(text: str) -> Iterator[np.ndarray]:
    """The bytes of a text's lower-case words, with one space around each, in blocks."""
    for block in word_blocks(text):
        yield np.frombuffer((" " + " ".join(block).lower() + " ").encode(), np.uint8)


def _strings(octets: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place; 0 for strings that hold parts of two words."""
    n = max(0, len(octets) - gram + 1)
    hashes, across = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(gram):
        part = octets[i : n + i]
        hashes = hashes * np.uint64(0x100000001B3) + part
        across |= (part == 32) & (0 < i < gram - 1)
    return np.where(across, 0, hashes)


def sketch(text: str) -> list[int]:
    """The four smallest hashes of a text's runs of three words."""
    smallest: set[int] = set()
    held: list[str] = []
    for block in word_blocks(text):
        words = held + [word.lower() for word in block]
        runs = {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(len(words) - 2)}
        smallest, held = set(heapq.nsmallest(4, smallest | runs)), words[-2:]
    return sorted(smallest or {zlib.crc32(" ".join(held).encode())})


def _train(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; their end, where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def condensed(text: str) -> list[bytes]:
    """What a text's words, six at a time, hold in common, in at most about CONDENSED bytes; all of them if they fit."""
    kept: list[bytes] = []
    for block in word_blocks(text):
        words = [word.lower().encode() for word in block]
        kept += [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, len(words), WORDS)]
        if sum(map(len, kept)) > CONDENSED:
            kept = [_train(CONDENSED, kept)]
    return kept


def unlike(sample: Sample) -> DataFrame:
    """The sampled rows without near copies of earlier ones of their label, which would make their strings look common."""
    sketches = F.pandas_udf(lambda texts: texts.map(lambda text: sketch(text or "")), ArrayType(LongType()))
    rows = sample.rows.select("doc_id", "label", sketches("text").alias("sketch")).collect()
    seen: dict[int, set[int]] = {0: set(), 1: set()}
    kept = []
    for row in sorted(rows, key=lambda r: r["doc_id"]):
        if not seen[row["label"]].intersection(row["sketch"]):
            kept.append((row["doc_id"],))
        seen[row["label"]].update(row["sketch"])
    ids = sample.rows.sparkSession.createDataFrame(kept, StructType([StructField("doc_id", sample.rows.schema["doc_id"].dataType)]))
    return sample.rows.join(F.broadcast(ids), "doc_id")


def distinctive(rows: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """(gram, string): the strings that far more toxic than ordinary documents hold, counted over all ``rows``.

    ``sizes`` are the numbers of ordinary and toxic rows. A task counts the documents of a batch that hold a string
    before they are exchanged; of a document it holds the distinct strings.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for gram in GRAMS:
                for label, texts in batch.groupby("label")["text"]:
                    held = []
                    for text in texts:
                        own = np.zeros(0, np.uint64)
                        for octets in _octets(text or ""):
                            own = np.union1d(own, _strings(octets, gram))
                        held.append(own[own > 0])
                    strings, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"gram": gram, "string": strings.view(np.int64), "label": label, "n": n})

    ordinary, toxic = sizes
    share = toxic / (toxic + ordinary)
    found, seen = (F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)).cast("double") for y in (1, 0))
    counted = (
        rows.select("label", "text")
        .mapInPandas(count, "gram int, string long, label int, n long")
        .groupBy("gram", "string")
        .agg(found.alias("found"), seen.alias("seen"))
    )
    total = F.col("found") + F.col("seen")
    evidence = 2 * (
        F.col("found") * F.log(F.col("found") / (total * share)) + F.col("seen") * F.log(F.greatest("seen", F.lit(1.0)) / (total * (1 - share)))
    )
    ratio = (F.col("found") / toxic) / ((F.col("seen") + 1) / ordinary)
    good = counted.where("found > 0").withColumn("evidence", evidence).where((F.col("evidence") >= EVIDENCE) & (ratio >= RATIO))
    return good.orderBy(F.desc("evidence"), "gram", "string").limit(STRINGS).select("gram", "string")


def toxic_segments(sample: Sample) -> list[bytes]:
    """The commonest segments of words that set toxic texts apart, rarer ones first, enough to fill TOXIC_BYTES."""
    from recordloom.session import stage

    rows = stage(unlike(sample), "unlike")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return []
    found = distinctive(rows, (sizes[0], sizes[1])).collect()
    good = {gram: np.array([r["string"] for r in found if r["gram"] == gram], np.int64).view(np.uint64) for gram in GRAMS}
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(good)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            segments: Counter[bytes] = Counter()
            for text in batch["text"]:
                for octets in _octets(text or ""):
                    inside = np.zeros(len(octets) + 2, int)
                    for gram, strings in shipped.value.items():
                        for at in np.flatnonzero(np.isin(_strings(octets, gram), strings)):
                            inside[at + 1 : at + gram + 1] = 1
                    edges = np.flatnonzero(np.diff(inside))
                    for start, stop in zip(edges[::2], edges[1::2]):
                        segments[octets[start:stop].tobytes()] += 1
            yield pd.DataFrame({"segment": list(segments), "n": list(segments.values())})

    segments = rows.where("label = 1").select("text").mapInPandas(cut, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    top = segments.orderBy(F.desc("n"), F.desc("segment")).limit(TOXIC_BYTES // min(GRAMS) + 1).collect()
    return [bytes(r["segment"]) for r in reversed(top)]


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = ridge * len(y) * np.r_[np.ones(len(w) - 1), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x
        step = np.linalg.solve(hessian + np.diag(keep + 1e-9), x.T @ (weights * (p - y)) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(sample: Sample) -> Model:
    """The dictionaries and the calibration. The driver gets CONDENSED bytes, a sketch and the features of each sampled text."""
    size = len(GAINS) + 1
    prior = math.log((sample.totals[1] + 1) / (sample.totals[0] + 1))
    flat = Model(b" ", b" ", (0.0,) * size + (prior,), (0.0,) * size, (1.0,) * size)
    if not all(sample.totals):
        return flat
    condense = F.pandas_udf(lambda texts: texts.map(lambda text: condensed(text or "")), ArrayType(BinaryType()))
    plain = sample.rows.where("label = 0").select("doc_id", condense("text").alias("pieces")).collect()
    pieces = [bytes(piece) for row in sorted(plain, key=lambda r: r["doc_id"]) for piece in row["pieces"]]
    base = _train(ORDINARY_BYTES, pieces) or b" "
    core = b"".join(toxic_segments(sample))[-TOXIC_BYTES:]
    # The same ordinary text in both; the ordinary dictionary repeats some of it where the toxic one has its segments.
    model = Model(base + base[: len(core)].ljust(len(core)), base + core, flat.weights, flat.mean, flat.scale)

    @F.pandas_udf(ArrayType(DoubleType()))
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = model.features()
        for texts in batches:
            yield texts.map(lambda text: features(text or ""))

    rows = sorted(sample.rows.select("doc_id", "label", described("text").alias("x")).collect(), key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    weights = sample.weights(y)
    mean = np.average(x, axis=0, weights=weights)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weights)) + 1e-9
    found = _logistic((x - mean) / scale, y, weights)
    return Model(model.ordinary, model.toxic, tuple(found), tuple(mean), tuple(scale))


def scorer(model: Model):
    """A column function from whole texts to scores."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = model.features()
        for texts in batches:
            yield pd.Series([model.score(features(text or "")) for text in texts], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; only labels that meet ``usable`` (a condition on doc_id) are learned from."""
    ship_package(docs.sparkSession)
    model = fit(labelled_sample(docs, labels, "toxic", SAMPLE, usable))
    return docs.select("doc_id", scorer(model)("text").alias("score"))
