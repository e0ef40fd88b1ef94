"""Phrases of words that occur together, mined by vertical partitioning of the suffixes.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and at spaces and tabs into words. Every place of a
word starts a suffix, which ends with its piece or after ``DEPTH`` words. The number of times a phrase occurs is the number
of suffixes that it begins: the total of its node in the tree of all suffixes of its language.

1. **Encoding.** Tasks replace words by numbers of their own, in chunks of about ``CHUNK`` words of one language, and
   write these chunks: a list of distinct words and an array of numbers. Texts are read once.
2. **Vertical partitioning.** The frequencies of single words are counted. A word that begins more suffixes than the
   memory ``BUDGET`` allows is extended: the frequencies of its two-word prefixes are counted, of those beyond the budget the
   three-word ones. A suffix belongs to its shortest prefix within the budget; these prefixes are dealt to groups
   so that a group holds about one budget of suffixes, by a hash. The prefixes beyond the budget, whose counts are known by then, are the
   only thing that is broadcast; there are at most ``MOST_PREFIXES`` of a length, since the budget is at least the
   words' total divided by that.
3. **Subtrees.** Each chunk sends its distinct suffixes with their counts, sorted and compressed, one row for each
   group. A task reads a group whole, sorts it, and adds the counts of the leaves up to the nodes above them.
   Groups do not depend on each other, and a lost one is built again from its rows.
4. **Scores.** Nodes with at least ``LEAST`` occurrences are joined with the nodes of their parts. A part that begins or ends
   many phrases is a hot key of that join; ``join_groups`` broadcasts those.

A line that fills a third of the table is one suffix row for each chunk and place. Sums and scores are decimal or whole
numbers, so nothing is rounded before the floor.

Defined results: a null text is empty; a null language is ``und``, and shares its counts with a language of that name.
Repeated rows count each time. Ties of a phrase's cuts go to the shorter first part, ties of a rank to the more frequent and then the
smaller phrase. Phrases without LEAST occurrences are never candidates, so an empty or short table gives an empty
result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import byte_words, join_groups
from recordloom.operators.limits import top_per_group
from recordloom.session import ship_package, stage

DEPTH = 4
LEAST = 30
TOP = 2000
#: Words of a chunk.
CHUNK = 1 << 19
#: Suffixes of a group.
BUDGET = 1 << 18
#: Suffixes of a group that are taken apart into words at a time.
LINES = 1 << 16
#: Prefixes of one length that can be beyond the budget.
MOST_PREFIXES = 1 << 16

_UPPER = bytes(range(0x41, 0x5B))
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to a-z, tabs to spaces, the ends of pieces to one byte that no word can hold.
_TABLE = bytes.maketrans(_UPPER + b"\t" + _ENDS, _UPPER.lower() + b" " + b"." * len(_ENDS))
_END = b"."


# --- chunks ------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Words to numbers in the order of their first appearance; 0 ends a piece."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words, ids): the distinct words of a chunk in order, and the numbers of its words, from 1; 0 ends a piece."""
    held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    size = 0

    def chunks() -> Iterator[pa.RecordBatch]:
        for lang, (numbers, parts) in held.items():
            words = sorted(numbers.keys() - {_END})
            place = np.zeros(len(numbers), "<i4")
            place[[numbers[word] for word in words]] = np.arange(1, len(words) + 1)
            ids = place[np.concatenate(parts)].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([words], pa.list_(pa.binary())), pa.array([ids], pa.binary())], names=["lang", "words", "ids"]
            )

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            numbers, parts = held.setdefault(lang, (_Numbers(), []))
            # The mark must stand between spaces to be split off like a word.
            data = text.as_py().encode().translate(_TABLE).replace(_END, b" . ")
            for words in byte_words(data, _TABLE):
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(words)
            parts.append(np.zeros(1, np.int32))
            if size >= CHUNK:
                yield from chunks()
                held, size = {}, 0
    yield from chunks()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place, the number, the inverse) of the distinct keys, in their order."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[starts], np.diff(np.r_[starts, len(keys)]), inverse


class Chunk:
    """The words of a chunk and its numbers, which follow the order of the words."""

    def __init__(self, lang: str, words: pa.Array, ids: bytes) -> None:
        self.lang = lang
        self.ids = np.frombuffer(ids, "<i4").astype(np.int64)
        self.words = pa.concat_arrays([pa.array([""]), words.cast(pa.string())])

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.ids[np.minimum(places, len(self.ids) - 1)]  # every chunk ends with a 0

    def counted(self, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a place, the number, the inverse) of the distinct prefixes of ``depth`` words at ``places``, in their order.

        A suffix that ends earlier is a prefix of its own.
        """
        width = len(self.words)
        keys, bound = self.ids[places], width
        ended = keys == 0
        for d in range(1, depth):
            if bound * width >= 1 << 63:
                _, found, keys = _distinct(keys)
                bound = len(found)
            following = np.where(ended, 0, self.at(places + d))
            ended |= following == 0
            keys, bound = keys * width + following, bound * width
        first, counts, inverse = _distinct(keys)
        return places[first], counts, inverse

    def phrases(self, places: np.ndarray, depth: int) -> tuple[pa.Array, np.ndarray]:
        """The words of the suffix at each place, at most ``depth``, joined by spaces; and how many there are."""
        length = np.zeros(len(places), np.int64)
        columns, going = [], np.ones(len(places), bool)
        for d in range(depth):
            ids = np.where(going, self.at(places + d), 0)
            going = ids > 0
            length += going
            columns.append(self.words.take(pa.array(ids, mask=~going)))
        return pc.binary_join_element_wise(*columns, " ", null_handling="skip"), length


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for lang, words, ids in zip(*(batch.column(c) for c in ("lang", "words", "ids"))):
            yield Chunk(lang.as_py(), words.values, ids.as_py())
            pa.default_memory_pool().release_unused()


def _prefix_counts(hot: dict[str, set[str]], depth: int):
    """Counts of the prefixes of ``depth`` words that extend a prefix of ``hot``; of all words at depth 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            places = np.flatnonzero(chunk.ids)
            if depth > 1:
                if not hot.get(chunk.lang):
                    continue
                places = places[_inside(chunk, places, hot[chunk.lang], depth - 1)]
            if not len(places):
                continue
            first, counts, _ = chunk.counted(places, depth)
            phrases, length = chunk.phrases(first, depth)
            whole = length == depth
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk.lang] * int(whole.sum()), pa.string()), phrases.filter(pa.array(whole)), pa.array(counts[whole])], names=["lang", "phrase", "n"]
            )

    return run


def _inside(chunk: Chunk, places: np.ndarray, wanted: set[str], depth: int) -> np.ndarray:
    """Whether the ``depth`` words from each place are one of the ``wanted`` phrases."""
    # Only places whose words all belong to wanted phrases are compared as text.
    known = pc.is_in(chunk.words, pa.array({word for phrase in wanted for word in phrase.split(" ")}, pa.string())).to_numpy(zero_copy_only=False)
    maybe = reduce(np.logical_and, (known[chunk.at(places + d)] for d in range(depth)))
    out = np.zeros(len(places), bool)
    if maybe.any():
        first, _, inverse = chunk.counted(places[maybe], depth)
        phrases, _ = chunk.phrases(first, depth)
        out[maybe] = np.array([p in wanted for p in phrases.to_pylist()])[inverse]
    return out


def _suffixes(hot: list[dict[str, set[str]]], groups: int):
    """(group, lang, phrases, counts): the distinct suffixes of two words or more of a chunk, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk in _chunks(batches):
            places = np.flatnonzero(chunk.ids)
            places = places[chunk.at(places + 1) > 0]
            if not len(places):
                continue
            places, counts, _ = chunk.counted(places, DEPTH)
            # The number of words in a suffix's own prefix: one more than in its longest prefix beyond the budget.
            own = np.ones(len(places), np.int64)
            for depth, phrases in enumerate(hot, 1):
                if phrases.get(chunk.lang):
                    own += _inside(chunk, places, phrases[chunk.lang], depth)
            group = np.zeros(len(places), np.int64)
            for depth in np.unique(own).tolist():
                chosen = own == depth
                first, _, inverse = chunk.counted(places[chosen], depth)
                names, _ = chunk.phrases(first, depth)
                seed = chunk.lang + "\n"
                group[chosen] = np.array([xxhash.xxh64_intdigest(seed + name) % groups for name in names.to_pylist()], np.int64)[inverse]
            # Suffixes come in the order of their words, so each group's are sorted, too.
            order = np.argsort(group, kind="stable")
            lines, _ = chunk.phrases(places[order], DEPTH)
            lines = pc.binary_join_element_wise(lines, "", "\n")
            offsets, octets = np.frombuffer(lines.buffers()[1], np.int32), memoryview(lines.buffers()[2])
            counts, group = counts[order], group[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            stretches = list(zip(starts.tolist(), [*starts[1:].tolist(), len(group)]))
            blocks = [pack(octets[offsets[a] : offsets[b] - 1]) for a, b in stretches]
            numbers = [pack(counts[a:b].astype("<i8").tobytes()) for a, b in stretches]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[starts], pa.int64()), pa.array([chunk.lang] * len(starts)), pa.array(blocks, pa.binary()), pa.array(numbers, pa.binary())],
                names=["group", "lang", "phrases", "counts"],
            )

    return run


# --- subtrees ----------------------------------------------------------------------------------------


def subtree_totals(words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a leaf of each node, total of each node) from the leaves of a tree: rows of DEPTH numbers, 0 behind the last.

    Leaves in the order of their numbers are the leaves of the tree from left to right, so a node is a stretch of them.
    """
    order = np.lexsort(words.T[::-1])
    words, counts = words[order], counts[order]
    unlike = words[1:] != words[:-1]
    shared = np.where(unlike.any(axis=1), unlike.argmax(axis=1), words.shape[1])
    for depth in range(2, words.shape[1] + 1):
        starts = np.flatnonzero(np.r_[True, shared < depth])
        deep = words[starts, depth - 1] > 0
        yield depth, order[starts[deep]], np.add.reduceat(counts, starts)[deep]


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``words`` with the sums of their counts."""
    order = np.lexsort(words.T[::-1])
    words = words[order]
    starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
    return words[starts], np.add.reduceat(counts[order], starts)


class _Leaves:
    """The distinct suffixes of a group with their counts, as rows of DEPTH numbers; 0 stands behind a suffix's last word.

    A group's hash decides what it holds, so some hold several budgets. Texts are turned into numbers about LINES at a time, and
    repeated suffixes are added up whenever the rows have doubled: memory follows the distinct suffixes, 24 bytes each.
    """

    def __init__(self) -> None:
        self.names = pa.array([""], pa.large_string())
        self.texts: list[bytes] = []
        self.text_counts: list[np.ndarray] = []
        self.waiting = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows, self.bound = 0, 4 * LINES

    def add(self, text: bytes, counts: np.ndarray) -> None:
        """``text`` has a line for each of ``counts``."""
        self.texts.append(text)
        self.text_counts.append(counts)
        self.waiting += len(counts)
        if self.waiting >= LINES:
            self._number()

    def _number(self) -> None:
        lines = pc.split_pattern(pa.array([b"\n".join(self.texts)], pa.binary()).cast(pa.large_string()), "\n").flatten()
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.names)
        fresh = place.is_null().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).copy()
        place[fresh] = len(self.names) + np.arange(fresh.sum(), dtype=np.int32)
        self.names = pa.concat_arrays([self.names, coded.dictionary.filter(pa.array(fresh))])
        words = np.zeros((len(lines), DEPTH), np.int32)
        # Rows are filled from left to right, so the places of a row's words come in their order.
        words[np.arange(DEPTH) < pc.list_value_length(split).to_numpy()[:, None]] = place[coded.indices.to_numpy()]
        self.parts.append((words, np.concatenate(self.text_counts)))
        self.rows += len(words)
        self.texts, self.text_counts, self.waiting = [], [], 0
        if self.rows >= self.bound:
            self._sum()
            self.bound = max(self.bound, 2 * self.rows)

    def _sum(self) -> None:
        words, counts = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = [_summed(words, counts)]
        self.rows = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(rows, counts, the word of each number)."""
        if self.waiting:
            self._number()
        self._sum()
        return *self.parts[0], self.names


def _nodes(least: int):
    """(lang, phrase, n) of the nodes with ``least`` occurrences, from rows that come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress

        def built(lang: str, leaves: _Leaves) -> pa.RecordBatch:
            words, counts, names = leaves.all()
            phrases, totals = [], []
            for depth, leaf, total in subtree_totals(words, counts):
                often = total >= least
                phrases.append(pc.binary_join_element_wise(*(names.take(pa.array(k)).cast(pa.string()) for k in words[leaf[often], :depth].T), " "))
                totals.append(total[often])
            phrases = pa.concat_arrays(phrases)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array(np.concatenate(totals))], names=["lang", "phrase", "n"])

        leaves, last = _Leaves(), None
        for batch in batches:
            for group, lang, text, n in zip(*(batch.column(c) for c in ("group", "lang", "phrases", "counts"))):
                if (group.as_py(), lang.as_py()) != last and last is not None:
                    yield built(last[1], leaves)
                    leaves = _Leaves()
                    pa.default_memory_pool().release_unused()
                last = (group.as_py(), lang.as_py())
                leaves.add(unpack(text.as_py()), np.frombuffer(unpack(n.as_py()), "<i8"))
        if last is not None:
            yield built(last[1], leaves)

    return run


# --- Spark -------------------------------------------------------------------------------------------

_COUNTS = "lang string, phrase string, n bigint"
#: Rows of chunks are megabytes long. Parquet would gather a hundred of them before it looks at their size, and readers take a row group at a time.
_ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of every phrase of at most DEPTH words with ``least`` occurrences, (lang, n_words))."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = stage(texts.mapInArrow(_encoded, "lang string, words array<binary>, ids binary"), "word_chunks", **_ROW_GROUPS)

    def prefixes(hot: dict[str, set[str]], depth: int) -> DataFrame:
        return chunks.mapInArrow(_prefix_counts(hot, depth), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))

    words = stage(prefixes({}, 1), "word_counts")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n_words"))
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(BUDGET, -(-total // MOST_PREFIXES))
    hot: list[dict[str, set[str]]] = []
    known = [words.where(F.col("n") >= least)]
    counts = words
    for depth in range(1, DEPTH):
        beyond: dict[str, set[str]] = {}
        for row in counts.where(F.col("n") > budget).collect():  # at most MOST_PREFIXES rows
            beyond.setdefault(row["lang"], set()).add(row["phrase"])
        if not beyond:
            break
        hot.append(beyond)
        if depth > 1:
            known.append(counts.where(F.col("n") > budget))
        if depth < DEPTH - 1:
            counts = stage(prefixes(beyond, depth + 1), "prefix_counts")
    groups = max(1, -(-total // budget))
    packed = "group bigint, lang string, phrases binary, counts binary"
    # Rows of one group are few and large, so there is a partition for each group up to a bound, beyond it several share one.
    dealt = chunks.mapInArrow(_suffixes(hot, groups), packed).repartition(min(groups, 1 << 14), "group").sortWithinPartitions("group", "lang")
    nodes = dealt.mapInArrow(_nodes(least), _COUNTS)
    # The nodes above a group's own prefixes are split over groups; their counts are known from the partitioning.
    above = reduce(DataFrame.unionByName, known[1:]) if known[1:] else None
    if above is not None:
        nodes = nodes.join(F.broadcast(above.select("lang", "phrase")), ["lang", "phrase"], "left_anti")
    return stage(reduce(DataFrame.unionByName, [nodes, *known]), "phrase_counts"), sizes


def _part(first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more in ``counts`` that no longer one mostly covers."""
    found = counts.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.size("words")
    cuts = found.select(
        "lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, size(words) - 1), k -> named_struct('k', k,"
        " 'first', array_join(slice(words, 1, k), ' '), 'rest', array_join(slice(words, k + 1, size(words) - k), ' ')))")).alias("cut")
    ).select("lang", "phrase", "a", "cut.*")
    cuts = stage(cuts.select("*", _key("lang", "first").alias("first_key"), _key("lang", "rest").alias("rest_key")), "phrase_cuts")
    n_cuts = cuts.count()
    totals = counts.select(_key("lang", "phrase").alias("key"), F.col("n"))

    def with_part(rows: DataFrame, key: str, name: str) -> DataFrame:
        uses = cuts.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("uses"))
        parts = stage(totals.join(uses, "key").select(F.col("key").alias(key), F.col("n").alias(name), "uses"), "phrase_parts")
        return join_groups(rows, parts, key, "uses", n_cuts).drop("uses")

    both = with_part(stage(with_part(cuts, "first_key", "l"), "first_parts"), "rest_key", "r")
    score = F.expr("cast(2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r) as bigint)")
    best = both.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    inner = found.where(size > 2).select(
        "lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1),"
        " i -> array_join(slice(words, i, m), ' '))))")).alias("phrase")
    )
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    dropped = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * 80
    kept = best.join(covered, ["lang", "phrase"], "left").where(~F.coalesce(dropped, F.lit(False)))
    return kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _key(lang: str, phrase: str) -> Column:
    """Language and phrase as one text; a phrase holds no line break."""
    return F.concat(F.col(lang), F.lit("\n"), F.col(phrase))


def top_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, count and phrase."""
    counts, sizes = count_phrases(docs, text, lang, least)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = top_per_group(stage(score_phrases(counts), "scored_phrases"), ["lang"], order, top)
    named = ranked.join(sizes.withColumnRenamed("n_words", "n"), "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
