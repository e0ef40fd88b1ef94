"""The classifiers against plain definitions: votes by a full sort, strings and gains by loops, class weights."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import common, knn_quality, toxicity


def test_votes_equal_a_full_sort():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, (12, knn_quality.TERMS + knn_quality.REPEAT_LEVELS)).astype(np.float32)
    counts = base[np.arange(60) % 12]  # five of each: many ties, also at the tenth place
    labels = (rng.random(60) < 0.5).astype(float)
    weights = np.where(labels == 1, 0.25, 1.5)
    model = knn_quality.build(counts, labels, weights, 0.4)
    asked = np.concatenate([base, np.zeros((1, base.shape[1]), np.float32)])
    got = model.score(asked)
    for row, score in zip(model.project(asked)[:-1], got):
        near = sorted((-round(float(row @ v) * knn_quality.SCALE), place) for place, v in enumerate(model.vectors))[: knn_quality.NEIGHBOURS]
        votes = [max(-s / knn_quality.SCALE, 1e-6) ** knn_quality.SHARPNESS * weights[place] for s, place in near]
        assert math.isclose(score, sum(v * labels[place] for v, (_, place) in zip(votes, near)) / sum(votes), abs_tol=1e-9)
    assert got[-1] == 0.4
    assert np.array_equal(np.concatenate([model.score(asked[i : i + 1]) for i in range(len(asked))]), got)


def test_training_terms_are_of_whole_texts(spark):
    text = "alpha beta " * 9000 + "zyzzyva " + "gamma delta " * 9000
    (row,) = spark.createDataFrame([(text,)], "text string").select(knn_quality.packed_terms("text").alias("t")).collect()
    assert np.array_equal(knn_quality._unpack(row.t), knn_quality.terms(text))
    assert len(knn_quality._unpack(b"")) == knn_quality.TERMS + knn_quality.REPEAT_LEVELS


def test_distinctive_strings_equal_loops(spark, monkeypatch):
    plain = [f"calm words number {i} stay as they are every day" for i in range(80)]
    bad = [f"calm words {i} but grumblefoo and sneerbar here" for i in range(40)]
    monkeypatch.setattr(common, "BLOCK_CHARS", 16)  # texts of several blocks
    rows = spark.createDataFrame([(i, int(i >= 80), t) for i, t in enumerate(plain + bad)], "doc_id long, label int, text string")
    got = {(r.gram, r.string) for r in toxicity.distinctive(rows, (80, 40)).collect()}
    want = set()
    for gram in toxicity.GRAMS:
        found, seen = Counter(), Counter()
        for texts, counts in ((bad, found), (plain, seen)):
            for text in texts:
                octets = (" " + " ".join(text.split()) + " ").encode()
                parts = {octets[i : i + gram] for i in range(len(octets) - gram + 1)}
                counts.update(p for p in parts if b" " not in p[1:-1])
        for part, n in found.items():
            m = seen[part]
            evidence = 2 * (n * math.log(n / ((n + m) / 3)) + (m * math.log(m / ((n + m) * 2 / 3)) if m else 0))
            if evidence >= toxicity.EVIDENCE and (n / 40) / ((m + 1) / 80) >= toxicity.RATIO:
                hashed = 0
                for b in part:
                    hashed = (hashed * 0x100000001B3 + b) % 2**64
                want.add((gram, hashed - 2**64 if hashed >= 2**63 else hashed))
    assert got == want and got


def test_features_equal_loops():
    model = toxicity.Model(b"calm words stay ", b"calm words stay grumblefoo", (0.0,) * 7, (0.0,) * 6, (1.0,) * 6)
    ordinary, toxic = toxicity._compressor(model.ordinary), toxicity._compressor(model.toxic)
    for text in ("", "one", "calm words stay and grumblefoo words stay grumblefoo calm grumblefoo", "Grumblefoo " * 30):
        words = text.lower().split()
        starts = range(0, max(len(words) - toxicity.WORDS, 0) + toxicity.STEP, toxicity.STEP) if words else []
        parts = [words[s : s + toxicity.WORDS] for s in starts if s == 0 or len(words) > s + toxicity.WORDS - toxicity.STEP]
        windows = [(" " + " ".join(p) + " ").encode() for p in parts]
        assert windows == list(toxicity.windows(text))
        gains = [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows]
        n = len(gains) + toxicity.STEP
        want = [sum(g for g in gains if g > 0) / n, *(sum(g >= k for g in gains) / n for k in toxicity.GAINS)]
        assert np.allclose(model.features()(text), np.log(np.array(want) + toxicity.FLOOR))


def test_sketches_and_condensed_texts(monkeypatch):
    text = " ".join(f"w{i % 400}x{i}" for i in range(3000))
    whole = toxicity.sketch(text)
    assert len(toxicity.sketch("")) == 1 and toxicity.sketch("a b") == toxicity.sketch("A  b")
    assert sum(map(len, toxicity.condensed(text))) <= toxicity.CONDENSED
    assert b"".join(toxicity.condensed("A b c")) == b" a b c " and toxicity.condensed("") == []
    monkeypatch.setattr(common, "BLOCK_CHARS", 100)
    assert toxicity.sketch(text) == whole
    assert sum(map(len, toxicity.condensed(text))) <= toxicity.CONDENSED


@pytest.mark.parametrize("operator", ["toxicity", "quality"])
def test_more_labels_of_the_same_kind_change_nothing(spark, monkeypatch, operator):
    module, score, label = (
        (toxicity, toxicity.score_toxicity, "toxic") if operator == "toxicity" else (knn_quality, knn_quality.score_quality, "quality")
    )
    monkeypatch.setattr(module, "SAMPLE", (60, 40))
    rng = np.random.default_rng(7)
    calm = [f"word{i}" for i in range(200)]

    def text(toxic: bool) -> str:
        words = list(rng.choice(calm, 24))
        return " ".join(words[:8] + ["grumblefoo"] * toxic + words[8:16] + ["sneerbar"] * toxic + words[16:])

    texts = [text(i % 4 == 3) for i in range(100)]
    asked = spark.createDataFrame([(-1, text(False)), (-2, text(True)), (-3, "")], "doc_id long, text string")
    said = []
    for n in (100, 400):
        docs = spark.createDataFrame([(i, texts[i % 100]) for i in range(n)], "doc_id long, text string")
        labels = docs.select("doc_id", (F.col("doc_id") % 4 == 3).cast("int").alias(label))
        rows = score(docs.union(asked), labels, F.lit(True)).where("doc_id < 0").orderBy("doc_id").collect()
        said.append([r.score for r in rows])
        sample = common.labelled_sample(docs, labels, label, module.SAMPLE, F.lit(True))
        assert sample.totals == (3 * n // 4, n // 4)
        drawn = np.array([r.label for r in sample.rows.collect()])
        weights = sample.weights(drawn)
        assert math.isclose(weights[drawn == 1].sum() / weights.sum(), 0.25) and math.isclose(weights.mean(), 1)
    assert [s >= 0.5 for s in said[0]] == [s >= 0.5 for s in said[1]] == [False, True, False], said
