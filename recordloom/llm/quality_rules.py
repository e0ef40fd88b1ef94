"""Quality rules by distribution divergence, with DataFrame operations only.

Every document has two histograms: of the classes of its characters, and of the commonest words of its language. Each
is compared with the language's reference by Jensen-Shannon distance (base 2, so 0 to 1). A document is rejected if a
distance exceeds its threshold, provided that it is long enough for the histogram to mean something; shorter ones pass.
Two base rules, too few words and too many words in repeated five-word windows, reject a document by themselves.

A reference is made of medians: of the shares of the language's distinct texts that pass the base rules and are long
enough, scaled to a sum of 1. Neither a group of junk copies nor one very long text can move it far.

One formula holds for every language, however small. With n such texts a language's own medians have the weight
n / (n + SHRINK), those of the whole table the rest. What is mixed is what languages have in common: the shares of four
coarse groups (letters with spaces and marks, numbers, punctuation, the rest), and the share of common words. How a group is
split into its classes, and the common words into single ones, is the language's own. So the only text of a language, which is all of
its own medians, is still held against the table, and a verdict does not jump when a document more arrives.

The rows without a language are one. A language outside ``COMMON_WORDS`` takes the commonest words of its own documents
as its list.

Defined results: a null text counts as empty, has no words and fails the base rule; an empty table gives an empty
result; repeated rows are judged alike. A language without a text that is good and long enough has no reference; none of its
documents would be compared with one. Texts without words add nothing to a list. Windows of words are compared by 64-bit
hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import join_groups, text_of, words
from recordloom.session import stage

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: So many texts of a language weigh as much as the whole table.
SHRINK = 10
#: Least code points and words for which a histogram is compared, and the distances from which a document is rejected.
CHAR_GUARD, CHAR_DISTANCE = 200, 0.3
WORD_GUARD, WORD_DISTANCE = 100, 0.27

#: Shares are rounded to so many steps for their medians, which bounds the values that an aggregation holds.
STEPS = 2000

SYMBOLS = r"[#*$%&|<>]"
#: Classes of characters, each taken from what the earlier ones have left; the last class is the rest.
CLASSES = (r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", r"[.,;:?'\"()-]+", r"\p{M}+")
#: The coarse group of each class: letters with spaces and marks, numbers, punctuation, the rest.
GROUPS = (0, 0, 0, 0, 1, 2, 0, 3)

# The commonest function words of each language.
COMMON_WORDS = {
    "en": "the of and to a in is that it for on was with as be by this are at from".split(),
    "de": "der die und in den von zu das mit sich des für auf ist im nicht dem eine ein als".split(),
    "fr": "de la le et les en des un du une est que pour dans qui au sur par pas avec".split(),
    "es": "de la que el en y los se del las por un con una no para su es al lo".split(),
}
SLOTS = 20


def repeated_windows(word_list: str) -> list[tuple[str, Column]]:
    """Steps that end in ``n_repeat_words``: the number of words in windows that the text holds twice or more."""
    ahead = ", ".join(f"{word_list}[i + {k}]" for k in range(1, WINDOW))
    n = WINDOW - 1
    hashes = f"transform(slice({word_list}, 1, greatest(size({word_list}) - {n}, 0)), (x, i) -> xxhash64(x, {ahead}))"
    return [
        ("hashes", F.expr(hashes)),
        # Only texts that repeat a window are sorted; equal neighbours then give the places of repeated windows.
        (
            "ordered",
            F.expr(
                "if(size(array_distinct(hashes)) < size(hashes),"
                " sort_array(transform(hashes, (h, i) -> struct(h, i))), cast(array() as array<struct<h: bigint, i: int>>))"
            ),
        ),
        (
            "places",
            F.expr(
                "sort_array(transform(filter(ordered, (x, j) -> coalesce(x.h = get(ordered, j - 1).h, false)"
                " or coalesce(x.h = get(ordered, j + 1).h, false)), x -> x.i))"
            ),
        ),
        (
            "n_repeat_words",
            F.expr(
                f"aggregate(places, struct(0L as n, 0 as done), (s, i) -> struct(s.n + i + {WINDOW} - greatest(s.done, i) as n,"
                f" i + {WINDOW} as done), s -> s.n)"
            ),
        ),
    ]


def _common_list(lang: str) -> Column:
    out = F.lit(None).cast("array<string>")
    for code, listed in COMMON_WORDS.items():
        out = F.when(F.col(lang) == code, F.array(*map(F.lit, listed))).otherwise(out)
    return F.coalesce(out, F.col("own_list"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``: the language as text that is never null."""
    lang = F.col("lang").cast("string")
    return docs.withColumn("key", F.when(lang.isNull(), "0").otherwise(F.concat(F.lit("1"), lang)))


def with_lists(docs: DataFrame) -> DataFrame:
    """``docs`` (text, key) with ``own_list``: the commonest words of a language outside COMMON_WORDS, else null.

    A word counts by its shares of the language's distinct texts, so neither a long text nor its copies outweigh others.
    Only rows of such languages are joined.
    """
    listed = F.col("key").isin(["1" + code for code in COMMON_WORDS])
    none = F.lit(None).cast("array<string>")
    others = stage(docs.where(~listed).groupBy("key").agg(F.count("*").alias("n")), "other_languages")
    total = others.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return docs.withColumn("own_list", none)
    texts = docs.where(~listed).select("key", F.lower(text_of()).alias("text")).dropDuplicates(["key", "text"])
    parts = texts.select("key", words(F.col("text")).alias("w")).select("key", F.floor(F.lit(1e9) / F.size("w")).alias("share"), F.explode("w").alias("word"))
    counted = parts.groupBy("key", "word").agg(F.sum("share").alias("share"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("share"), "word"))
    first = counted.withColumn("place", place).where(F.col("place") <= SLOTS).groupBy("key").agg(F.sort_array(F.collect_list("word")).alias("own_list"))
    lists = stage(others.join(first, "key"), "word_lists")
    met = join_groups(docs.where(~listed), lists, "key", "n", total, "left").drop("n")
    return docs.where(listed).withColumn("own_list", none).unionByName(met)


def histograms(df: DataFrame) -> DataFrame:
    """``df`` (text, lang, own_list, word_list) with ``classes`` and ``common``: counts of characters and of common words."""
    left = df.withColumn("left0", F.col("text"))
    for i, pattern in enumerate(CLASSES):
        left = left.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", pattern, ""))
    sizes = [F.length(f"left{i}") for i in range(len(CLASSES) + 1)]
    counts = [(a - b).cast("long") for a, b in zip(sizes, sizes[1:])] + [sizes[-1].cast("long")]
    found = F.expr("filter(transform(word_list, w -> array_position(listed, lower(w))), k -> k > 0)")
    bins = [(F.size("found") - F.size(F.array_remove("found", k))).cast("long") for k in range(1, SLOTS + 1)]
    rest = (F.size("word_list") - F.size("found")).cast("long")
    return (
        left.withColumn("listed", _common_list("lang"))
        .withColumn("found", found)
        .withColumn("classes", F.array(*counts))
        .withColumn("common", F.when(F.col("listed").isNotNull(), F.array(*bins, rest)))
        .drop("listed", "found", *(f"left{i}" for i in range(len(CLASSES) + 1)))
    )


def _medians(name: str, size: int, long_enough: Column) -> Column:
    """The medians of the shares of a histogram, in STEPS; null without a long text."""
    total = F.greatest(F.aggregate(name, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1))
    step = lambda i: F.when(long_enough, F.round(F.get(name, F.lit(i)) * STEPS / total).cast("int"))
    return F.array(*(F.percentile(step(i), 0.5) for i in range(size)))


def _scaled(values: list[float]) -> list[float] | None:
    total = sum(x or 0.0 for x in values)
    return [(x or 0.0) / total for x in values] if total else None


def _by_group(shares: list[Column], groups: tuple[int, ...]) -> list[Column]:
    return [sum((s for s, g in zip(shares, groups) if g == group), F.lit(0.0)) for group in range(max(groups) + 1)]


def _shrunk(medians: str, n: str, pooled: list[float], groups: tuple[int, ...]) -> Column:
    """A language's reference: its own medians, their sums by group drawn towards those of ``pooled``."""
    size = len(groups)
    total = F.nullif(F.aggregate(medians, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    own = [F.get(medians, F.lit(i)) / total for i in range(size)]
    weight = F.col(n) / (F.col(n) + F.lit(float(SHRINK)))
    whole = [sum(p for p, g in zip(pooled, groups) if g == group) for group in range(max(groups) + 1)]
    mine = _by_group(own, groups)
    mixed = [weight * a + (1 - weight) * b for a, b in zip(mine, whole)]
    shares = [
        F.when(mine[g] > 0, mixed[g] * x / mine[g]).otherwise(mixed[g] * (p / whole[g] if whole[g] else 0.0))
        for x, p, g in zip(own, pooled, groups)
    ]
    return F.when(total.isNotNull(), F.array(*shares))


def references(measured: DataFrame) -> tuple[DataFrame, int]:
    """(key, n, ref_classes, ref_common) of each language, and the number of rows."""
    chars, common = len(CLASSES) + 1, SLOTS + 1
    texts = stage(
        measured.where(~F.col("base_failed")).select("key", "text_hash", "n_chars", "n_words", "classes", "common").dropDuplicates(["key", "text_hash"]),
        "distinct_texts",
    )
    long, wordy = F.col("n_chars") >= CHAR_GUARD, (F.col("n_words") >= WORD_GUARD) & F.col("common").isNotNull()
    medians = [_medians("classes", chars, long).alias("c"), _medians("common", common, wordy).alias("w")]
    by_lang = texts.groupBy("key").agg(F.count_if(long).alias("n_c"), F.count_if(wordy).alias("n_w"), *medians)
    counts = measured.groupBy("key").agg(F.count("*").alias("n"))
    langs = stage(counts.join(by_lang, "key", "left"), "languages")
    total = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Of the table as a whole there are the medians of the classes, and of the share of common words.
    covered = F.when(wordy, F.round(STEPS - F.get("common", F.lit(SLOTS)) * STEPS / F.greatest("n_words", F.lit(1))).cast("int"))
    whole = texts.agg(medians[0], F.percentile(covered, 0.5).alias("covered")).first()
    classes = _scaled(whole["c"]) or [0.0] * chars
    share = (whole["covered"] or 0.0) / STEPS
    words_groups = (0,) * SLOTS + (1,)
    return langs.select(
        "key", "n", _shrunk("c", "n_c", classes, GROUPS).alias("ref_classes"),
        _shrunk("w", "n_w", [share / SLOTS] * SLOTS + [1 - share], words_groups).alias("ref_common"),
    ), total


def distance(counts: str, reference: str, total: Column) -> Column:
    """Jensen-Shannon distance of a document's counts from a reference's shares; null without a reference."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) * 0.5
    term = lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2)
    terms = F.zip_with(counts, reference, lambda n, q: term(n / total.cast("double"), q))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def failed() -> Column:
    """Whether a document breaks a base rule."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The counts of every document (row by row, no shuffle)."""
    df = docs.withColumns({"text": text_of(text), "lang": F.col(lang).cast("string"), "doc_id": F.col(doc_id)})
    df = df.withColumn("word_list", words(F.col("text")))
    df = df.withColumn("lines", F.expr(r"filter(split(text, '\n'), x -> trim(BOTH ' \t\n\u000b\f\r' FROM x) <> '')"))
    for name, step in repeated_windows("word_list"):
        df = df.withColumn(name, step)
    df = histograms(df)
    return df.withColumns(
        {
            "n_chars": F.length("text"),
            "n_words": F.size("word_list").cast("long"),
            "word_chars": F.length(F.array_join("word_list", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "text_hash": F.md5("text"),
        }
    ).withColumn("base_failed", failed()).drop("hashes", "ordered", "places", "lines", "word_list")


def judge(met: DataFrame) -> DataFrame:
    """Measured rows joined with their references, with the distances and kept."""
    for name, counts, ref, total in (("char_distance", "classes", "ref_classes", "n_chars"), ("word_distance", "common", "ref_common", "n_words")):
        met = met.withColumn(name, distance(counts, ref, F.greatest(F.col(total), F.lit(1))))
    off = (F.col("n_chars") >= CHAR_GUARD) & (F.col("char_distance") > CHAR_DISTANCE)
    odd = (F.col("n_words") >= WORD_GUARD) & (F.col("word_distance") > WORD_DISTANCE)
    verdict = ~F.col("base_failed") & ~F.coalesce(off, F.lit(False)) & ~F.coalesce(odd, F.lit(False))
    return met.withColumn("kept", verdict).drop("n", "text_hash")


def score_quality(docs: DataFrame) -> DataFrame:
    """One row per document with its counts, distances and verdict. Texts are read once; the counts are written."""
    measured = stage(measure(with_lists(keyed(docs.select("doc_id", "text", "lang")))).drop("text"), "quality_counts")
    refs, total = references(measured)
    return judge(join_groups(measured.drop("own_list"), stage(refs, "references"), "key", "n", total))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. Rows are written with their counts, so a text is measured once."""
    plain = keyed(docs.select(F.struct("*").alias("doc"), "doc_id", "text", "lang"))
    measured = stage(measure(with_lists(plain)).drop("text", "own_list"), "measured_rows")
    refs, total = references(measured)
    judged = judge(join_groups(measured, stage(refs, "references"), "key", "n", total))
    return judged.where("kept").select("doc.*")
