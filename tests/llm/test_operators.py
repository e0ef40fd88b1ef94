"""Operators and pipeline stages over awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import chat, chat_template, common, components, exact_dedup, knn_quality, line_dedup
from recordloom.llm import mixing, packing, quality_rules, simhash, suffix_dedup, toxicity
from recordloom.session import stage
from tests.llm.common import AWKWARD, LOREM, collected, empty, sha, table, words
from tests.llm.test_queries import components as slow_components
from tests.llm.test_queries import fingerprint, removed


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, AWKWARD)


def test_exact_dedup(spark, docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(AWKWARD)
    groups = Counter()
    for r in got:
        groups[r["hash"]] += r.kept
    assert set(groups.values()) == {1}
    three = [r for r in got if bytes(r["hash"]).hex() == sha("one two three")]
    assert {r.keep_id for r in three} == {2} and {r.group_size for r in three} == {3}
    assert sum(r.kept for r in got if r.doc_id == 8) == 0 and [r.kept for r in got if r.doc_id == 7] == [True]
    # Several ranges, and a filter so small that everything passes it, change nothing.
    assert collected(exact_dedup.exact_duplicates(docs, bits=64).drop("row")) == collected(exact_dedup.exact_duplicates(docs))
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0


def test_drop_exact_duplicates(docs):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    # Null and empty are equal; so are the three spellings of "one two three".
    assert sorted((r.doc_id or 0) for r in left.collect()) == [2, 3, 4, 7, 9, 10, 11, 12, 13]
    twice = exact_dedup.drop_exact_duplicates(docs.where("doc_id = 8"))
    assert twice.count() == 1


def test_hot_groups_join_as_others(spark):
    rows = stage(spark.range(4000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), "id"), "rows")
    groups = stage(rows.groupBy("k").agg(F.count("*").alias("n")), "groups")
    joined = common.join_groups(rows, groups.where("k % 2 = 0"), "k", "n", 4000)
    assert joined.count() == 2500 + 750 and joined.where("k = 0 and n = 2500").count() == 2500
    assert common.join_groups(rows, groups.where("k = 0"), "k", "n", 4000, "left").count() == 4000


def test_mixing_targets_and_copies(spark):
    texts = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 5 else None) for i in range(400)] + [(900 + i, "big " * 60, "tiny") for i in range(1)]
    docs = table(spark, texts)
    sizes, sources = mixing.plan_mixture(docs)
    rows = mixing.with_copies(sizes, sources, sizes.count()).collect()
    # Targets by plain arithmetic: share what is left by weight until no source is above three times its size.
    total = Counter()
    for _, text, source in texts:
        total[source] += len(words(text))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    held, before = set(), None
    while before != held:
        before = set(held)
        free = [s for s in total if s not in held]
        left = sum(total.values()) - sum(3 * total[s] for s in held)
        want = {s: weights[s] * left / sum(weights[f] for f in free) for s in free} | {s: 3 * total[s] for s in held}
        held |= {s for s in free if want[s] > 3 * total[s]}
    taken = Counter()
    for r in rows:
        source = None if r.key == "1" else r.key[1:]
        assert r.target == pytest.approx(want[source]) and r.source_size == total[source] and r.copies <= 3
        taken[source] += r["size"] * r.copies
    for s in ("s0", "s1", "s2", "s3", None):
        assert taken[s] == pytest.approx(want[s], rel=0.1)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert collected(mixed) == collected(mixing.mix(docs))
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("size", [2_500_000, 10**16])
def test_mixing_of_many_words(spark, size, monkeypatch):
    """Words times weights pass 32 bits (5 times a billion) and 64 bits; a small source is held at three times its size."""
    monkeypatch.setattr(mixing, "size_of", lambda text="text": F.when(F.col(text) == "few", 7).otherwise(size).cast("long"))
    texts = [(i, "many", f"s{i % 20:02}") for i in range(400)] + [(400, "few", "t")]
    docs = table(spark, texts)
    sizes, sources = mixing.plan_mixture(docs)
    words, weights = 400 * size + 7 - 21, [(5, 2, 1)[k % 3] for k in range(20)]
    found = {r.key[1:]: r for r in sources.collect()}
    assert found["t"].target == 21 and found["t"].rate == 3
    for k, weight in enumerate(weights):
        assert found[f"s{k:02}"].target == pytest.approx(words * weight / sum(weights))
    copies = Counter({r.doc_id: r.copies for r in mixing.with_copies(sizes, sources, sizes.count()).collect()})
    mixed = Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    assert mixed == +copies and mixed[400] == 3 and len(mixed) > 200


def test_mixing_awkward(docs):
    sizes, sources = mixing.plan_mixture(docs)
    assert mixing.with_copies(sizes, sources, sizes.count()).count() == len(AWKWARD)


def test_line_dedup(spark, docs):
    rows = [(i, t) for i, t in AWKWARD if i in (9, 10)] + [(20, "a\na\na\na\na"), (21, "line b\nline c\nline d"), (22, None), (23, "p\nq"), (24, "\n\n\n")]
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.drop_repeated_lines(table(spark, rows)).collect()}
    assert got[9] == (4, 0, 0, "line a\nline b\nline c\nline d")
    assert got[10] == (5, 3, 1, "x\ny")
    assert got[20] == (5, 4, 1, "a")
    assert got[21] == (3, 3, 1, "")
    assert got[22] == (0, 0, 0, "") and got[23] == (2, 0, 0, "p\nq") and got[24] == (4, 3, 1, "")
    # Every distinct line survives somewhere.
    left = {line for n, *_, text in got.values() if text for line in text.split("\n")}
    assert left == {line for _, t in rows if t for line in t.split("\n")} - {""} | ({""} if "" in left else set())
    assert line_dedup.drop_repeated_lines(docs).count() == len(AWKWARD)
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_quality_rules(spark, docs):
    judged = {(r.doc_id, r.n_words): r for r in quality_rules.score_quality(docs).collect()}
    assert judged[5, 0].base_failed and judged[9, 8].base_failed
    n = len(words(LOREM)) * 40
    assert judged[11, n].n_repeat_words == n and judged[11, n].base_failed
    for text in ("a b c d e f a b c d e g", "x " * 30, "a b c d e a b c d e a b c d e", "one two"):
        w = words(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        want = len({i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)})
        assert quality_rules.score_quality(table(spark, [(1, text)])).first().n_repeat_words == want
    random.seed(5)
    plain = [(i, " ".join(random.choice(LOREM.split()) for _ in range(150))) for i in range(30)]
    junk = [(100, " ".join(f"#{c}%%&|" * 3 for c in "abcdefghijklmnopqrstuvwxyz" * 6)), (101, "".join(f"{i} " for i in range(10_000, 10_300)))]
    good = quality_rules.keep_good(table(spark, plain + junk))
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, _ in plain}
    assert quality_rules.keep_good(empty(spark)).count() == 0


def test_best_fit_against_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(60):
        length = int(rng.integers(1, 40))
        lengths = rng.integers(1, length + 1, int(rng.integers(0, 60)))
        room: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [k for k, left in enumerate(room) if left >= n]
            at = min(fits, key=lambda k: room[k], default=None)
            if at is None:
                room.append(length)
                at = len(room) - 1
            room[at] -= n
        sequence, offset = packing.best_fit(lengths, length)
        assert len(set(sequence.tolist())) == len(room)
        ends = Counter()
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), lengths.tolist())):
            assert ends[s] == o
            ends[s] += n
        assert all(end <= length for end in ends.values())


def test_packing_awkward(spark, docs):
    rows = packing.pack(docs, shard_pieces=3).collect()
    assert sum(r.length for r in rows) == sum(len(r.ids) // 4 for r in rows)
    assert Counter(r.doc_id for r in rows)[8] == 2 and [r.length for r in rows if r.doc_id == 5] == [1]
    places = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places[r.sequence_id]
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 1024
    assert packing.pack(empty(spark)).count() == 0
    spaces = " " * 400_000  # the fast encoder gives up here
    assert len(packing.encoder()(spaces)) > 0


def test_encoder_is_the_librarys():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode, exact = packing.encoder(), Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["", "plain", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "<|EndOfText|>", "né 中文 \U0001f600\n\n\tz" * 50]
    for text in texts:
        assert list(encode(text)) == exact.encode(text, add_special_tokens=False).ids
    assert 50256 in encode("a <|endoftext|> b")


def test_simhash_awkward(spark, docs):
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [fingerprint(t or "") for _, t in AWKWARD]
    ids = [10**9 if i is None else i for i, _ in AWKWARD]
    assert got == Counter(zip([i for i, _ in AWKWARD], fps, slow_components(fps, ids)))
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(set(slow_components(fps, ids)))
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_of_large_blocks(spark, blocks):
    """A dense group of fingerprints, cut in chunks, keeps its components, whatever the number of blocks."""
    rng = random.Random(2)
    fps = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(150):
            fp = centre
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                fp ^= 1 << bit
            fps.add(fp)
    fps = sorted(fps)
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), chunk=16, blocks=blocks)
    roots = {r.node: r.root for r in components.components(found).collect()}
    want = slow_components(fps, list(range(len(fps))))
    same = lambda labels: {tuple(i for i, x in enumerate(labels) if x == y) for y in labels}
    assert same([roots.get(s[0], s[0]) for s in signed]) == same(want)


def test_blocks_grow_with_the_fingerprints():
    assert [simhash.block_count(n) for n in (0, 1 << 26, (1 << 26) + 1, 1 << 33, (1 << 33) + 1, 1 << 38)] == [6, 6, 7, 7, 8, 8]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(300, 301), (301, 300), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 60)} == {1} and got[301] == 300
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup_awkward(spark, docs):
    rows = AWKWARD + [(30, "ab" * 900), (31, "q" * 399), (31, LOREM * 9)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.drop_repeated_bytes(table(spark, rows)).collect())
    want = Counter((i, *x) for (i, _), x in zip(rows, removed([t or "" for _, t in rows])))
    assert got == want
    assert suffix_dedup.drop_repeated_bytes(empty(spark)).count() == 0


@pytest.mark.parametrize("alphabet", [1, 2, 26])
def test_repeated_starts_against_a_count(alphabet):
    rng = np.random.default_rng(alphabet)
    base = bytes(rng.integers(97, 97 + alphabet, 1500).astype(np.uint8))
    regions = [base[k : k + int(rng.integers(400, 600))] for k in rng.integers(0, 900, 8).tolist()]
    regions += [bytes(rng.integers(97, 97 + alphabet, 450).astype(np.uint8)) for _ in range(3)]
    seen = Counter(x[i : i + 400] for x in regions for i in range(len(x) - 399))
    for region, flags in zip(regions, suffix_dedup.repeated_starts(regions)):
        assert flags.tolist() == [seen[region[i : i + 400]] > 1 for i in range(len(region) - 399)]


def test_runs_cross_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    octets = np.random.default_rng(3).integers(97, 123, 5000).astype(np.uint8)
    runs = list(suffix_dedup.Anchors().runs(octets))
    assert [a for a, *_ in runs] == np.cumsum([0, *(n for _, n, *_ in runs)])[:-1].tolist() and sum(n for _, n, *_ in runs) == 4601


def test_a_shard_takes_a_bounded_multiple_of_its_bytes():
    base = bytes(np.random.default_rng(5).integers(97, 123, 4000).astype(np.uint8))
    regions = [base[k % 3000 :][:600] + bytes([97 + k % 26]) * 400 for k in range(0, 300)]
    suffix_dedup.repeated_starts(regions[:2])
    tracemalloc.start()
    suffix_dedup.repeated_starts(regions)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * sum(map(len, regions))


def test_batches_are_bounded_by_bytes():
    rng = np.random.default_rng(7)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes().decode() for n in [8000] * 2000 + [6_000_000, 0, 300]]
    key = pa.array([{"a": i, "b": -i} for i in range(len(texts))])
    ids = pa.array(range(len(texts)), pa.int64())
    given = lambda **more: iter([pa.RecordBatch.from_pydict({"doc_id": ids, "key": key, "text": pa.array(texts), **more})])
    runs = list(suffix_dedup._runs(given()))
    assert max(b.nbytes for b in runs) < 3 << 20
    assert sum(r for b in runs for r in b.column("n_starts").to_pylist()) == sum(max(0, len(t) - 399) for t in texts)
    wanted = [[] for _ in texts]
    for b in runs:
        for r in b.select(["doc_id", "start", "n_starts", "anchor", "region"]).to_pylist():
            wanted[r.pop("doc_id")].append(r | {"hot": False})
    cut = list(suffix_dedup._cut(given(wanted=pa.array(wanted))))
    assert max(b.nbytes for b in cut) < 3 * (1 << 21)
    slow = [(w["anchor"], t[w["start"] : w["start"] + w["n_starts"] + 399].encode()) for t, ws in zip(texts, wanted) for w in ws]
    assert [x for b in cut for x in zip(b.column("anchor").to_pylist(), b.column("bytes").to_pylist())] == slow
    covered = pa.array([[{"a": 10, "b": 20}] if i % 2 else None for i in range(len(texts))])
    kept = list(suffix_dedup._kept(given(covered=covered)))
    assert max(b.nbytes for b in kept) < 7_000_000 and len(kept) > 4
    assert [x.decode() for b in kept for x in b.column("kept").to_pylist()] == [t[:10] + t[20:] if i % 2 else t for i, t in enumerate(texts)]


def test_chat_round_trip():
    random.seed(1)
    alphabet = ["\\", "<turn>", "</turn>", "### ", ": ", "Assistant", "assistant", "user", "<", "/", "turn>", ":", " ", "\n", "x", "é", "\U0001f600"]
    render = chat_template.compile_template(chat.TURN, chat.FILTERS)
    for _ in range(3000):
        role, text = ("".join(random.choices(alphabet, k=random.randint(0, n))) for n in (4, 8))
        out = render({"turn": {"role": role, "text": text}})
        match = chat.MARKED.fullmatch(out.text())
        assert (chat.role_of(match[1]), chat.unescape(match[2])) == (role, text)
        assert [chat.unescape(out.text()[a:b]) for a, b in out.spans] == ([text] if role == "assistant" else [])


def test_chat_template_of_a_conversation(spark):
    """Header, separators and footer; the parts of a streamed conversation are the whole template's text and spans."""
    source = (
        "[{{ conv_id }}|{% for turn in turns %}{{ loop.index }}/{{ loop.index0 }}:{% if turn.role == 'assistant' %}{% generation %}"
        "{{ turn.text|escape }}{% endgeneration %}{% else %}{{ turn.role ~ '=' ~ turn.text }}{% endif %}"
        "{% if loop.first %}!{% endif %}{% if not loop.last %}, {% endif %}{% endfor %}]"
    )
    rows = [(c, t, ("user", "assistant")[t % 2], f"say {t} \\ {c}") for c in range(5) for t in range(1 + c * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    whole = chat_template.compile_template(source, chat.FILTERS)
    got = chat.format_conversations(df, source).orderBy("conv_id", "place").collect()
    for c in range(5):
        out = whole({"conv_id": c, "turns": [{"role": r, "text": x} for conv, _, r, x in rows if conv == c]})
        own = [r for r in got if r.conv_id == c]
        assert "".join(r.formatted for r in own) == out.text() and [r.turn for r in own] == list(range(1 + c * 3))
        assert [(r.start + s.start, r.start + s.stop) for r in own for s in r.spans] == out.spans
    assert whole({"conv_id": 1}).text() == whole({"conv_id": 1, "turns": []}).text() == "[1|]"
    with pytest.raises(chat_template.TemplateError):
        whole({"turns": "text"})
    for bad in ("no loop", "{% for a in b %}{% endfor %}", "{% for a in turns %}{% endfor %}{% for a in turns %}{% endfor %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_stream(bad, {}, "turns")
    for bad in ("{% for loop in b %}{% endfor %}", "{% for a of b %}{% endfor %}", "{% endfor %}", "{% if a %}{% endfor %}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{% if a %}" * 60 + "{% endif %}" * 60):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad, {})
    with pytest.raises(ValueError, match="whole number"):
        chat.format_conversations(df.withColumn("conv_id", F.lit("c1")))


def test_chat_awkward(spark):
    turns = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (None, None, None, None), (None, 3, "user", "x"), (1, 1, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("user\nhi\nassistant\n\nassistant\n\n") and got[1].loss_chars == 0
    assert got[None].turns_sha256 == digest("user\nx\n\n\n") and got[None].n_turns == 2
    assert chat.read_back(chat.format_conversations(df.where("false"))).count() == 0
    big = (1 << 62) + 1  # ids beyond the exact range of doubles survive beside nulls
    wide = spark.createDataFrame([(big, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chat.read_back(chat.format_conversations(wide)).collect()} == {big, None}


def test_template_language():
    parse, fold = chat_template.parse, chat_template.fold
    assert fold(parse("a{{ 1 + 2 }}b{% if 1 < 2 and true %}c{% else %}{{ x }}{% endif %}d{{ 'q' ~ 1 }}", {})) == (
        chat_template.Emit(chat_template.Const("a3bcdq1")),
    )
    render = chat_template.compile_template("{% if a == 'x' or b %}1{% elif not c %}2{% else %}3{% endif %}{{ d['k'].z }}{{ t.join }}", {})
    assert render({"a": "y", "c": 1, "d": {"k": {"z": 5}}, "t": "s"}).text() == "35"
    for bad in ("{% if x %}", "{{ x.__class__ }}", "{{ x.f() }}", "{{ x|nope }}", "{% for a in b %}", "{% endif %}", "{{ 1 + 'a' }}", "{{ 'a }}", "{{ }}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad, {})


@pytest.mark.parametrize("operator", ["toxicity", "quality"])
def test_classifiers_awkward(spark, docs, operator):
    score = toxicity.score_toxicity if operator == "toxicity" else knn_quality.score_quality
    schema = "doc_id long, quality int, toxic int, text string"
    none = spark.createDataFrame([], schema)
    scores = [r.score for r in score(docs, none, F.lit(True)).collect()]
    assert len(scores) == len(AWKWARD) and len(set(scores)) == 1 and 0 < scores[0] < 1
    odd = spark.createDataFrame([(11, 1, 0, "c"), (11, 1, 0, "c"), (13, 0, 1, "c"), (None, 0, 1, "c"), (9, None, None, "c")], schema)
    by_id = {r.doc_id: r.score for r in score(docs, odd, F.lit(True)).collect()}
    assert all(0 <= s <= 1 for s in by_id.values())
    assert score(empty(spark), odd, F.lit(True)).count() == 0


def test_words_of_long_texts_are_not_cut(monkeypatch):
    text = "alpha beta " * 500 + "x" * 3000 + " tail"
    monkeypatch.setattr(common, "BLOCK_CHARS", 64)
    assert [w for block in common.word_blocks(text) for w in block] == text.split()
    long = list(toxicity.windows(text))
    monkeypatch.setattr(common, "BLOCK_CHARS", 1 << 20)
    assert list(toxicity.windows(text)) == long
    assert list(toxicity.windows("a b")) == [b" a b "] and list(toxicity.windows("")) == []


def test_positions_over_tasks(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "key string").repartition(7)
    assert [r.place for r in stage(common.with_position(df, "key", "place"), "p").orderBy("key").collect()] == list(range(300))


def test_pipeline_stages(spark, docs, sf_dir):
    for table_ in (docs, empty(spark)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, table_, sf_dir).columns == docs.columns


def test_pipeline_against_plain_python(spark, sf_dir):
    """Each stage's decisions follow from those of its operator, recomputed by plain definitions where that is possible."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in quality_rules.score_quality(documents).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in documents.collect() if r.doc_id in good)
    first = {}
    for i, text in rows:
        first.setdefault(" ".join(words(" " + text + " ")) + repr((text[:1].isspace(), text[-1:].isspace())), (i, text))
    rows = sorted(first.values())
    ids = [i for i, _ in rows]
    kept = set(slow_components([fingerprint(t) for _, t in rows], ids))
    rows = {i: t for i, t in rows if i in kept}
    docs = documents.where(F.col("doc_id").isin(list(rows)))
    mixed = Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == mixed
    assert all(r.offset + r.length <= 1024 for r in got)


def tail_docs(spark):
    """Clean prose in English and in a language without a word list, junk in small languages and without a language."""
    rng = random.Random(8)
    prose = lambda listed, n=150: " ".join(rng.choice(listed) for _ in range(n))
    other = "se de och att det som en på är av för med till den har i om ett men sig så man kan när".split()
    rows = [(i, prose(LOREM.split()), "en") for i in range(3000)]
    rows += [(4000 + i, prose(other), "sv") for i in range(12)] + [(4100, prose([f"xq{i}" for i in range(120)]), "sv")]
    rows += [(4200 + i, prose(other), None) for i in range(12)]
    junk = " ".join("".join(rng.choice("#*$%&|<>") for _ in range(9)) for _ in range(60))
    digits = " ".join(str(rng.randrange(10**8)) for _ in range(60))
    rows += [(5000, junk, "aa"), (5001, digits, "ab"), (5002, junk, None), (5003, digits, "sv"), (5004, prose(other), "ac")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_quality_of_small_languages(spark):
    docs = tail_docs(spark)
    judged = {r.doc_id: r.kept for r in quality_rules.score_quality(docs).collect()}
    assert len(judged) == docs.count()
    assert {i for i, kept in judged.items() if not kept} == {4100, 5000, 5001, 5002, 5003}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {i for i, kept in judged.items() if kept}


@pytest.mark.parametrize("junk", ["copies", "near copies", "one long text"])
def test_quality_references_withstand_junk(spark, junk):
    rng = random.Random(9)
    symbols = lambda n: " ".join("".join(rng.choice("#*$%&|<>") for _ in range(9)) for _ in range(n))
    clean = [(i, " ".join(rng.choice(LOREM.split()) for _ in range(150))) for i in range(60)]
    bad = {"copies": [symbols(90)] * 30, "near copies": [symbols(90) for _ in range(30)], "one long text": [symbols(3000)]}[junk]
    docs = table(spark, clean + [(100 + i, text) for i, text in enumerate(bad)])
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == {i for i, _ in clean}


# --- op3: one formula for every language -----------------------------------------------------------------


def prose(rng, words, n):
    weight = 1 / np.arange(1, len(words) + 1)
    return " ".join(rng.choice(words, n, p=weight / weight.sum()))


def tail_table(swedish):
    """English documents, some of a small language with one word salad among them, and junk without a language of its own."""
    rng = np.random.default_rng(1)
    vocabulary = {
        "en": [*quality_rules.COMMON_WORDS["en"], *(f"word{chr(97 + i)}s" for i in range(26))],
        "sv": ["och", "att", "det", "som", "en", "den", "med", "har", "inte", "till", *(f"ord{chr(97 + i)}" for i in range(26))],
    }
    rows = [("en", prose(rng, vocabulary["en"], 150)) for _ in range(60)]
    rows += [("sv", prose(rng, vocabulary["sv"], 150)) for _ in range(swedish - 1)]
    rows.append(("sv", " ".join("".join(rng.choice(list("qxzvkj"), 6)) for _ in range(150))))
    rows += [("zz", "#% $& " * 100 + f"only {i} words here are not signs of any kind at all") for i in range(2)]
    rows += [(None, prose(rng, vocabulary["en"], 150)) for _ in range(5)]
    rows += [(None, "&& ## " * 80 + "ten words that keep the rule of least words from failing")]
    rows += [("zh", " ".join("".join(rng.choice(list("水山田木火土金石日月"), 4)) for _ in range(60))), ("nu", " ".join(str(n) for n in range(1000, 1300)))]
    return [(i, text, lang) for i, (lang, text) in enumerate(rows)]


def test_verdicts_do_not_jump_with_a_language_growing(spark):
    for swedish in (9, 10, 11):
        docs = spark.createDataFrame(tail_table(swedish), "doc_id long, text string, lang string")
        kept = {r.doc_id: r.kept for r in quality_rules.score_quality(docs).collect()}
        by_lang = {i: lang for i, _, lang in tail_table(swedish)}
        salad = 60 + swedish - 1
        assert not kept[salad]
        assert all(kept[i] for i, lang in by_lang.items() if lang in ("en", "sv") and i != salad)
        junk = [i for i, lang in by_lang.items() if lang in ("zz", "nu")] + [max(i for i, lang in by_lang.items() if lang is None)]
        assert not any(kept[i] for i in junk)
        assert kept[min(i for i, lang in by_lang.items() if lang is None)] and kept[next(i for i, lang in by_lang.items() if lang == "zh")]


def test_tail_languages_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from recordloom.llm.queries import ORACLE, QUERIES
    from workload.check import digest

    rows = [*tail_table(9), (900, None, "en"), (901, "", None), (902, "ett", "sv"), (903, "x " * 40, "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op3_quality_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE["op3_quality_rules"])
    columns = [c[0] for c in want.description]
    assert digest([tuple(r) for r in found.collect()], found.columns)[1] == digest(want.fetchall(), columns)[1]
