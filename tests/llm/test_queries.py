"""Registered queries: those with SQL agree with it, the others with plain Python."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from recordloom.llm import packing
from recordloom.llm.queries import ORACLE, QUERIES
from tests.llm.common import words
from workload import check


@pytest.fixture(scope="module")
def docs(sf_dir):
    return sorted((r["doc_id"], r["text"] or "") for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "ORACLE", ORACLE)
    good, note = check.compare(spark, check.connect(sf_dir), sf_dir, name)
    assert good, note


def test_packing_query(spark, sf_dir, docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    found = collections.defaultdict(dict)
    places = collections.defaultdict(list)
    for r in QUERIES["op4_best_fit_packing"](spark, sf_dir).collect():
        found[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    total = 0
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        pieces = [found[doc_id][i] for i in range(len(found[doc_id]))]
        assert all(p.length == 1024 for p in pieces[1:]) and sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            part = np.array(ids[p.start : p.start + p.length], "<u4")
            assert len(part) == p.length <= 1024 and zlib.crc32(part.tobytes()) == p.ids_crc32
        total += len(ids)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= total / 1024 * 1.02 + 1


def fingerprint(text):
    import xxhash

    tokens = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [min(ids[k] for k in range(len(fps)) if root(k) == root(i)) for i in range(len(fps))]


def test_simhash_query(spark, sf_dir, docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_near_dedup"](spark, sf_dir).collect())
    fps = [fingerprint(text) for _, text in docs]
    ids = [i for i, _ in docs]
    assert got == [(i, f"{fp:016x}", c) for i, fp, c in zip(ids, fps, components(fps, ids))]


def test_chat_query(spark, sf_dir):
    turns = collections.defaultdict(list)
    for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = {r.conv_id: r for r in QUERIES["op8_chat_formatting"](spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for conv_id, own in turns.items():
        own.sort()
        loss = "".join(text for _, role, text in own if role == "assistant")
        row = got[conv_id]
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(own), len(loss), digest(loss))
        assert row.turns_sha256 == digest("".join(f"{role}\n{text}\n" for _, role, text in own))
        assert row.formatted_chars > sum(len(text) for _, _, text in own)


def removed(texts, length=400):
    data = [text.encode() for text in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot", [1 << 19, 1500])
def test_suffix_dedup_query(spark, sf_dir, docs, hot, monkeypatch):
    from recordloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = QUERIES["op9_suffix_array_dedup"](spark, sf_dir).collect()
    assert all(r.has_repeats == (r.n_removed > 0) and r.removed_share == r.n_removed / max(r.n_bytes, 1) for r in rows)
    got = sorted(tuple(r)[:5] for r in rows)
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for (i, _), (n, gone, spans, kept) in zip(docs, removed([t for _, t in docs]))]
    assert got == want


@pytest.mark.parametrize(("name", "label", "parts", "held", "least"), [("op1_toxicity", "toxic", 3, 1, 0.95), ("op7_quality_classifier", "quality", 5, 0, 0.97)])
def test_classifiers_on_held_out_labels(spark, name, label, parts, held, least):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == pq.read_table(f"{sf_dir}/documents.parquet").num_rows
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) and 0 <= r.score <= 1 for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert sum(judged) / len(judged) >= least


def test_all_are_registered():
    assert [name.split("_")[0] for name in sorted(QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{n}" for n in range(1, 14)]
    assert packing.END == 2
