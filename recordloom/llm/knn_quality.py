"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

The terms of a document are its byte trigrams, hashed to ``TERMS`` counters, and one term for the share of words that
repeat the word before. Square roots of term shares are weighted by inverse document frequency and projected on the
leading ``DIMENSIONS`` singular vectors of a bounded sample of labelled documents, whose terms are counted in tasks from
whole texts. The sample's vectors (at most sum(SAMPLE) rows of DIMENSIONS numbers) go to every task; each document is
compared with all of them, exactly, in blocks of cosine products. The ``NEIGHBOURS`` nearest vote with their labels,
weighted by a power of similarity and by how many usable labels of its class a sampled one stands for, so that the
shares of the classes, and with them the meaning of a score, do not depend on the size of the sample.

Defined results: a null or empty text has no terms, a zero vector and the share of good labels as its score, as has
every text if there are no labels of both kinds. Similarities are compared in steps of 1 / SCALE; equal ones keep the
order of the sample (by doc_id). Repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from recordloom.llm.common import Sample, labelled_sample, word_blocks
from recordloom.session import ship_package

#: The most labelled documents (of label 0 and of label 1) that are searched.
SAMPLE = (2048, 2048)
TERM_BITS = 12
TERMS = 1 << TERM_BITS
REPEAT_LEVELS = 21
DIMENSIONS = 64
NEIGHBOURS = 10
SHARPNESS = 8
#: Similarities are rounded to 1 / SCALE, so that they do not depend on the block that a document is in.
SCALE = 1 << 20
#: Documents are projected and compared in blocks of so many rows; long texts are counted in blocks of bytes.
ROWS, BYTES = 256, 1 << 20


def terms(text: str) -> np.ndarray:
    """The term counts of a whole text."""
    out = np.zeros(TERMS + REPEAT_LEVELS, np.float32)
    octets = np.frombuffer(text.encode(), np.uint8)
    for at in range(0, max(0, len(octets) - 2), BYTES):
        b = octets[at : at + BYTES + 2].astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        out[:TERMS] += np.bincount(mixed * np.uint32(0x27D4EB2F) >> np.uint32(32 - TERM_BITS), minlength=TERMS)
    repeats = n_words = 0
    last = None
    for block in word_blocks(text):
        if block:
            repeats += sum(map(str.__eq__, block, block[1:])) + (block[0] == last)
            n_words, last = n_words + len(block), block[-1]
    if n_words > 1:
        share = repeats / (n_words - 1)
        out[TERMS + min(int(share * 40), REPEAT_LEVELS - 1)] = 0.3 * len(octets) * min(1.0, 10 * share)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for documents without terms."""
        shares = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9))
        return _unit(_unit(shares * self.idf) @ self.axes)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of each row's NEIGHBOURS nearest labelled documents, in any order."""
        similar = np.rint(self.project(counts) @ self.vectors.T * SCALE).astype(np.int64)
        n = len(self.labels)
        # One number for similarity, then place: all are different, so no tie is left to the selection.
        ranked = np.arange(n) - similar * n
        k = min(NEIGHBOURS, n)
        found = np.argpartition(ranked, k - 1, axis=1)[:, :k]
        found = np.take_along_axis(found, np.argsort(np.take_along_axis(ranked, found, axis=1), axis=1), axis=1)
        return found, np.take_along_axis(similar, found, axis=1) / SCALE

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        found, similar = self.nearest(counts)
        weight = np.clip(similar, 1e-6, None) ** SHARPNESS * self.weights[found]
        votes = (weight * self.labels[found]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts.any(axis=1), np.clip(votes, 0, 1), self.prior)


@F.pandas_udf(BinaryType())
def packed_terms(texts: pd.Series) -> pd.Series:
    """The term counts of whole texts that are not zero: their places (16 bits), then their values (32-bit floats)."""

    def pack(text: str) -> bytes:
        counts = terms(text or "")
        places = np.flatnonzero(counts)
        return places.astype("<u2").tobytes() + counts[places].astype("<f4").tobytes()

    return texts.map(pack)


def _unpack(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    out = np.zeros(TERMS + REPEAT_LEVELS, np.float32)
    out[np.frombuffer(packed, "<u2", n)] = np.frombuffer(packed, "<f4", n, 2 * n)
    return out


def fit(sample: Sample) -> Model:
    """The latent space and the labelled vectors. The driver gets the sample's term counts, at most 25 KB a document."""
    rows = sorted(sample.rows.select("doc_id", "label", packed_terms("text").alias("terms")).collect(), key=lambda r: r["doc_id"])
    labels = np.array([r["label"] for r in rows], float)
    prior = (sample.totals[1] + 1) / (sum(sample.totals) + 2)
    none = np.zeros((0, 0))
    if not 0 < labels.sum() < len(labels):
        return Model(none, none, none, np.array([]), np.array([]), prior)
    return build(np.array([_unpack(r["terms"]) for r in rows]), labels, sample.weights(labels), prior)


def build(counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float) -> Model:
    """The model of term counts, labels and class weights, a row for each labelled document."""
    parts = [slice(at, at + ROWS) for at in range(0, len(counts), ROWS)]
    common = sum(weights[part] @ (counts[part] > 0) for part in parts)
    idf = np.log((1 + len(counts)) / (1 + common)) + 0.5
    weighted = np.empty_like(counts)
    for part in parts:
        shares = np.sqrt(counts[part] / np.maximum(counts[part].sum(axis=1, keepdims=True), 1e-9))
        weighted[part] = _unit(shares * idf)
    # Randomised subspace iteration with a fixed seed; the sample is small.
    width = min(DIMENSIONS + 20, *weighted.shape)
    basis = weighted @ np.random.default_rng(0).standard_normal((weighted.shape[1], width)).astype(np.float32)
    for _ in range(3):
        basis = weighted @ (weighted.T @ np.linalg.qr(basis)[0])
    axes = np.linalg.svd(np.linalg.qr(basis)[0].T @ weighted, full_matrices=False)[2][:DIMENSIONS].T.astype(float)
    model = Model(idf, axes, np.zeros((0, 0)), labels, weights, prior)
    return Model(idf, axes, np.concatenate([model.project(counts[part]) for part in parts]), labels, weights, prior)


def scorer(model: Model):
    """A column function from whole texts to scores. The model is broadcast; its size is bounded by SAMPLE."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [texts.iloc[at : at + ROWS] for at in range(0, len(texts), ROWS)]
            scores = [model.score(np.array([terms(text or "") for text in part])) for part in rows]
            yield pd.Series(np.concatenate(scores) if scores else [], dtype="float64")

    return score


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; only labels that meet ``usable`` (a condition on doc_id) are learned from."""
    ship_package(docs.sparkSession)
    model = fit(labelled_sample(docs, labels, "quality", SAMPLE, usable))
    return docs.select("doc_id", scorer(model)("text").alias("score"))
