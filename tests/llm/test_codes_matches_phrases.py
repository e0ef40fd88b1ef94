"""Vector codes, benchmark decontamination and collocations against plain Python, awkward rows included."""

import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from recordloom.llm import collocations, decontamination, vector_codes
from recordloom.session import stage
from tests.llm.common import AWKWARD, SCHEMA, empty, rows, table

# --- vector codes ------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id string, code int, part string, n double"


def vectors(spark, found):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2.0) for i, v, label in found], VECTORS)


def plain_codes(found, parts, entries, rounds):
    kept = [(i, v, y) for i, v, y in found if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [[int(np.floor(4096 * float(np.float32(x)))) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for v in cut:
                members[nearest(p, v[p])[1]].append(v[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else old for e, old in enumerate(books[p])]
    out = []
    for (i, _, y), v in zip(kept, cut):
        best = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, y, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, books


def test_codes_of_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    found = [(i, [float(x) for x in rng.normal(0, 0.2, 16).astype("f4")], i % 3) for i in range(60)]
    found += [(100 + i, found[7][1], None) for i in range(40)]  # one vector fills a third of the rows
    found += [(3, found[4][1], 9), (None, found[5][1], 1), (None, found[6][1], None)]
    found += [(200, None, 1), (201, [None] + found[1][1][1:], 1), (202, [float("nan")] + found[1][1][1:], 1), (203, [float("inf")] * 16, 0)]
    coded, books = vector_codes.encode(vectors(spark, found), parts=4, entries=5, rounds=3)
    want, plain = plain_codes(found, 4, 5, 3)
    assert sorted(map(tuple, coded.select("id", "label", "code", "error").collect()), key=repr) == sorted(want, key=repr)
    assert [book.tolist() for book in books] == plain
    sums = collections.Counter()
    for _, y, _, e in want:
        sums[y] += e
    assert all(r.label_error == sums[r.label] for r in vector_codes.label_errors(coded).collect())


def test_few_vectors_and_refusals(spark):
    two = vectors(spark, [(2, [0.5] * 8, 1), (1, [-0.00001] * 8, 1)])
    coded, books = vector_codes.encode(two)
    assert [len(b) for b in books] == [2] * 8 and books[0].tolist() == [[-1], [2048]]
    assert {r.id: (r.code, r.error) for r in coded.collect()} == {1: ("00" * 8, 0), 2: ("01" * 8, 0)}
    none, books = vector_codes.encode(two.where("vec_id > 5"))
    assert none.collect() == [] and books == []
    assert vector_codes.label_errors(none).collect() == []
    for bad in ([(1, [0.1] * 8, 1), (2, [0.1] * 16, 1)], [(1, [0.1] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.encode(vectors(spark, bad))


@pytest.mark.parametrize("block", [1, 7, 100, 4096])
def test_trie_finds_the_nearest_entry(block, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(block)
    parts = np.unique(rng.integers(-4, 4, (500, 3)), axis=0)
    book = rng.integers(-4, 4, (6, 3))
    entry, distance = vector_codes.nearest_entries(parts, book)
    every = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert len(vector_codes.nearest_entries(parts[:0], book)[0]) == 0


# --- decontamination ---------------------------------------------------------------------------------


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_hits(texts, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = collections.defaultdict(set)
    for name, text in items:
        w = cut(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            windows[tuple(w[i : i + window])].add("" if name is None else str(name))
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, who = cut(text), set(), set()
        for i in range(len(w)):
            for m in sizes:
                if i + m <= len(w) and tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    who |= windows[tuple(w[i : i + m])]
        out.append((len(w), len(hit), sorted(who)))
    return out


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ITEMS = [(1, PASSAGE), (20, "Short item, three"), (3, None), (4, " -- "), (None, "né 中文 ok"), (1, "one two three four five six seven eight nine ten"), (5, "a a a a a a a a a a a a")]
DOCS = [
    None, "", "...", PASSAGE, PASSAGE.upper(), "say " + PASSAGE.replace(" ", "; ") + " end", "short ITEM three", "short item four", "x né-中文\nok y né 中文",
    "alpha beta gamma delta epsilon zeta eta theta iota", "beta gamma delta epsilon zeta eta theta iota kappa lambda stop", "a " * 25, "a " * 9,
    "one two three four five six seven eight nine ten " * 3 + PASSAGE, " ".join(["word"] * 3000) + " short item three", PASSAGE, PASSAGE,
]


@pytest.mark.parametrize(("shard", "stretch", "block_words"), [(8 << 20, 1 << 21, 1 << 21), (40, 16, 1 << 21), (200, 64, 20)])
def test_decontamination_of_awkward_texts(spark, shard, stretch, block_words, monkeypatch):
    for name, value in (("SHARD", shard), ("STRETCH", stretch), ("BLOCK_WORDS", block_words)):
        monkeypatch.setattr(decontamination, name, value)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(decontamination)  # the tasks see the settings, too
    try:
        docs = table(spark, list(enumerate(DOCS)))
        items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, row int")
        found = {r.row.doc_id: r.found for r in decontamination.scan_documents(docs, items).collect()}
        for i, (n, hit, who) in enumerate(plain_hits(DOCS, ITEMS)):
            got = found[i]
            assert (got.n_words, sum(s.b - s.a for s in got.spans), got["items"]) == (n, hit, who), DOCS[i]
            assert all(s.a < s.b for s in got.spans) and all(x.b < y.a for x, y in zip(got.spans, got.spans[1:]))
        left = decontamination.drop_contaminated(docs, items)
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == [i for i, (_, hit, _) in enumerate(plain_hits(DOCS, ITEMS)) if not hit]
    finally:
        cloudpickle.unregister_pickle_by_value(decontamination)


def test_longest_matches(spark):
    docs = table(spark, [(1, "x beta gamma delta stop"), (2, "delta epsilon zeta eta theta iota kappa"), (3, "nothing here"), (4, None)])
    items = spark.createDataFrame([(7, PASSAGE), (8, "gamma delta stop beta"), (9, "absent words")], "item_id long, text string")
    got = {r.item_id: tuple(r)[1:] for r in decontamination.longest_matches(docs, items).collect()}
    assert got == {"7": (7, 3, "2", 0), "8": (3, 0, "1", 2)}


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.scan_documents(empty(spark), items).collect() == []
    clean = decontamination.scan_documents(table(spark, [(1, PASSAGE), (2, None)]), items.where(F.lit(False))).collect()
    assert [(r.found.n_words, r.found.spans, r.found["items"]) for r in clean] == [(14, [], []), (0, [], [])]
    assert decontamination.longest_matches(table(spark, [(1, PASSAGE)]), items.where(F.lit(False))).collect() == []


def test_suffix_array_is_ordered():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 400)
    ids[100:200] = ids[:100]
    for depth in (1, 5, 10, 64):
        array = decontamination.suffix_array(ids, depth).tolist()
        assert sorted(array) == np.flatnonzero(ids).tolist()

        def suffix(at):
            out = ids[at : at + depth].tolist()
            return out[: out.index(0)] if 0 in out else out

        listed = [suffix(at) for at in array]
        assert listed == sorted(listed)


# --- collocations ------------------------------------------------------------------------------------


def plain_collocations(texts, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 5):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    chosen = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    found = collections.defaultdict(list)
    for (lang, w), a in chosen.items():
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        longer = [b for (other, v), b in chosen.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= 80 * a for b in longer):
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    out = []
    for lang, rows in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_texts():
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "a", "New", "York", "x\x01", "é", "中文", "b\x00c", "river", "Bank", "\x1f"]
    weight = np.array([9, 7, 5, 4, 4, 2, 2, 2, 1, 1, 1, 1]) / 39
    texts = []
    for i in range(150):
        w = rng.choice(vocabulary, int(rng.integers(0, 40)), p=weight).tolist()
        text = "".join(x + str(rng.choice([" ", "  ", "\t", ", ", ".", "\n", " - "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) for x in w)
        texts.append((["en", "de", None, "und"][i % 4], text))
    texts += [("en", "in the New York river bank of a")] * 40 + [("en", None), (None, ""), ("fr", "once only")]
    return texts


@pytest.mark.parametrize(("chunk", "budget"), [(1 << 22, 1 << 19), (300, 1 << 19), (300, 40), (2000, 400)])
def test_collocations_of_awkward_texts(spark, chunk, budget, monkeypatch):
    from pyspark import cloudpickle

    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "BUDGET", budget)
    texts = phrase_texts()
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "n", 2, "size", 3.0, "doc") for i, (lang, t) in enumerate(texts)], SCHEMA).withColumnRenamed("doc", "phrase")
    cloudpickle.register_pickle_by_value(collocations)
    try:
        got = sorted(map(tuple, collocations.top_collocations(docs, least=5, top=60).collect()))
    finally:
        cloudpickle.unregister_pickle_by_value(collocations)
    assert got == plain_collocations(texts, 5, 60)


def test_collocations_of_little(spark):
    assert collocations.top_collocations(empty(spark)).collect() == []
    assert collocations.top_collocations(spark.createDataFrame(rows(AWKWARD[:6]), SCHEMA)).collect() == []


def test_memory_of_a_group_follows_its_distinct_suffixes(monkeypatch):
    """Two chunks' rows of a group, repeated: the same sums, in memory that the number of rows does not multiply."""
    pack = zstandard.ZstdCompressor(level=1).compress
    lines = sorted(f"a w{i % 700} x{i % 90} y{i % 11}" for i in range(20_000)) + ["z end", "\x01 b\x00c"]

    def batches(times):
        row = [pa.array([5, 5]), pa.array(["en", "en"])]
        for part in range(times):
            texts = [pack("\n".join(lines[a::2]).encode()) for a in (0, 1)]
            counts = [pack(np.full(len(lines[a::2]), 1 + a, "<i8").tobytes()) for a in (0, 1)]
            yield pa.RecordBatch.from_arrays([*row, pa.array(texts), pa.array(counts)], names=["group", "lang", "phrases", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([5]), pa.array(["fr"]), pa.array([pack(b"z end")]), pa.array([pack(np.full(1, 9, "<i8").tobytes())])], names=["group", "lang", "phrases", "counts"])

    def plain(times):
        totals = collections.Counter()
        for at, line in enumerate(lines):
            w = line.split(" ")
            for depth in range(2, len(w) + 1):
                totals["en", " ".join(w[:depth])] += times * (1 + at % 2)
        return totals + collections.Counter({("fr", "z end"): 9})

    def measured(times):
        found = collections.Counter()
        tracemalloc.start()
        for batch in collocations._nodes(1)(batches(times)):
            for lang, phrase, n in zip(*(c.to_pylist() for c in batch.columns)):
                assert (lang, phrase) not in found
                found[lang, phrase] = n
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == plain(times)
        return peak

    monkeypatch.setattr(collocations, "LINES", 1 << 12)
    assert measured(40) < 2 * measured(4)


def test_chunks_lie_in_small_row_groups(spark, monkeypatch):
    """A row group of chunks is read whole, so it must not gather a hundred of them."""
    from pyspark import cloudpickle

    monkeypatch.setattr(collocations, "CHUNK", 20_000)
    monkeypatch.setitem(collocations._ROW_GROUPS, "parquet.block.size", 200_000)
    written = []
    monkeypatch.setattr(collocations, "stage", lambda df, label, *a, **k: written.append((label, stage(df, label, *a, **k))) or written[-1][1])
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 20_000)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    cloudpickle.register_pickle_by_value(collocations)
    try:
        collocations.count_phrases(docs)
    finally:
        cloudpickle.unregister_pickle_by_value(collocations)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in dict(written)["word_chunks"].inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40
    assert max(g.total_byte_size for g in groups) < 600_000


def test_leaf_totals():
    words = np.array([[2, 1, 0, 0], [1, 2, 3, 0], [1, 2, 3, 4], [1, 2, 0, 0], [1, 2, 3, 0]])
    counts = np.array([5, 1, 10, 100, 1000])
    got = {(depth, tuple(words[leaf][:depth])): int(n) for depth, at, total in collocations.subtree_totals(words, counts) for leaf, n in zip(at, total)}
    assert got == {(2, (1, 2)): 1111, (2, (2, 1)): 5, (3, (1, 2, 3)): 1011, (4, (1, 2, 3, 4)): 10}
