"""A small table with the awkward cases, and helpers to run stages over it."""

import hashlib
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash int, size string, n double, doc string"
EXTRA = ("x", 1, "y", 2.0, "z")  # columns whose names operators use inside

LOREM = "the water of this river is cold and it was as clear as the air on that day by the mill with a view from the hill "


def rows(texts):
    """(id, text) or (id, text, source) tuples as rows of SCHEMA."""
    return [(i, t, "en", s[0] if s else "a", None, *EXTRA) for i, t, *s in texts]


def table(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


AWKWARD = [
    (5, None),
    (4, ""),
    (3, " \t\n"),
    (None, "one two three"),
    (None, "one two three"),
    (2, "one  two\tthree"),
    (7, "ONE two three four five"),
    (8, "ONE two three four five"),
    (8, "ONE two three four five"),
    (9, "line a\nline b\nline c\nline d"),
    (10, "x\nline a\nline b\nline c\ny"),
    (11, LOREM * 40),
    (12, LOREM * 40 + "end"),
    (13, "éß\U0001f600 " * 300),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def empty(spark):
    return table(spark, [(1, "x")]).where(F.lit(False))
