"""Line deduplication over overlapping three-line windows, with DataFrame operations only.

The lines of a text are what ``\\n`` separates. Every run of three consecutive lines is a window, identified by two
64-bit hashes. A window that occurs several times, anywhere in the table, is first where (id, row, place) is smallest;
the lines covered by its later occurrences are removed. Windows are judged on the input. A line is only removed if an
earlier occurrence of its window holds the same line, so every distinct line of the table survives at least once.

Occurrences are counted by partial aggregation, so a window that a third of all rows share crosses the shuffle once
a task. Only occurrences of repeated windows are brought together with their group, hot groups by broadcast, and only
places of lines, never texts, are gathered by document.

Defined results: a null text counts as empty and has no lines; texts under three lines have no window and stay
whole, an empty line is a line like others; rows without an id come last, repeated ids are told apart by a row number
that is written once. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import join_groups, text_of
from recordloom.session import stage

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def covered_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, covered): the written table (row, doc_id, lines) and (row, places), the 0-based lines to remove."""
    lines = stage(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), lines_of(text_of(text)).alias("lines")),
        "lines",
    )
    starts = F.expr(f"sequence(0, size(lines) - {WINDOW})")
    own = ", ".join(f"lines[i + {k}]" for k in range(WINDOW))
    windows = stage(
        lines.where(F.size("lines") >= WINDOW)
        .withColumn("i", F.explode(starts))
        .select(
            F.expr(f"named_struct('a', xxhash64({own}), 'b', xxhash64('second', {own}))").alias("window"),
            F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "i").alias("at"),
        ),
        "windows",
    )
    groups = stage(
        windows.groupBy("window").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated_windows"
    )
    later = join_groups(windows, groups, "window", "n", windows.count()).where("at <> first")
    places = later.select("at.row", F.explode(F.expr(f"sequence(at.i, at.i + {WINDOW - 1})")).alias("line"))
    return lines, places.groupBy("row").agg(F.collect_set("line").alias("places"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_spans, text): each row's text without the covered lines, which form n_spans runs."""
    lines, covered = covered_lines(docs, doc_id, text)
    met = lines.join(covered, "row", "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    gone = F.expr("sort_array(places)")
    spans = F.expr("aggregate(gone, named_struct('n', 0L, 'last', -2), (s, x) -> named_struct('n', s.n + if(x = s.last + 1, 0L, 1L), 'last', x), s -> s.n)")
    kept = F.expr("if(size(places) = 0, lines, transform(array_except(sequence(0, size(lines) - 1), places), i -> lines[i]))")
    left = F.when(F.size("places") == F.size("lines"), F.lit("")).otherwise(F.array_join(kept, "\n"))
    return met.withColumn("gone", gone).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("places").cast("long").alias("n_removed"),
        spans.alias("n_spans"),
        left.alias("text"),
    )
