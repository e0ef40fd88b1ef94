"""Text rules: stripping, folding to ASCII, organization name keys, column names, placeholder codes."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legal-form words that may end an organization name.
LEGAL_SUFFIXES = (
    "ASSN", "ASSOCIATION", "CO", "COMPANY", "CORP", "CORPORATION", "INC", "INCORPORATED", "LC",
    "LLC", "LLP", "LP", "LTD", "LIMITED", "PA", "PC", "PLLC",
)
_NON_ASCII = r"[^\x00-\x7F]"
# Around every non-ASCII character, but not inside a surrogate pair.
_CHARACTER_EDGE = rf"(?![\x{{DC00}}-\x{{DFFF}}])(?:(?<={_NON_ASCII})|(?={_NON_ASCII}))"


@lru_cache(maxsize=1)
def whitespace() -> str:
    """Every code point Unicode-aware stripping removes."""
    return "".join(chr(p) for p in range(0x3001) if chr(p).isspace())


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decompositions that leave ASCII letters behind.

    Folding is per code point (everything non-ASCII is dropped afterwards, so mark order is moot):
    single-letter results become one ``translate``, the rest a small map.
    """
    source, target, longer = [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if not unicodedata.decomposition(char):
            continue
        kept = "".join(c for c in unicodedata.normalize("NFKD", char) if ord(c) < 0x80)
        if len(kept) == 1:
            source.append(char)
            target.append(kept)
        elif kept:
            longer.append((char, kept))
    return "".join(source), "".join(target), tuple(longer)


def strip(value: Column) -> Column:
    """Remove leading and trailing white space, the Unicode kinds included."""
    return F.btrim(value, F.lit(whitespace()))


def blank_to_null(value: Column) -> Column:
    """The null rule of every snapshot: empty or white space only is null."""
    return F.nullif(strip(value), F.lit(""))


def ascii_fold(value: Column) -> Column:
    """Compatibility-decompose and drop whatever is not ASCII."""
    source, target, longer = _fold_tables()
    # One constant literal; the optimizer folds it to a map.
    expansions = F.str_to_map(
        F.lit("\x01".join(f"{char}\x02{kept}" for char, kept in longer)), F.lit("\x01"), F.lit("\x02")
    )
    # Runs of ASCII and single other characters; only the latter are looked up.
    pieces = F.split(F.translate(value, source, target), _CHARACTER_EDGE)
    folded = F.transform(
        pieces,
        lambda p: F.when(p > "\x7f", F.coalesce(F.element_at(expansions, p), F.lit(""))).otherwise(p),
    )
    return F.when(value.rlike(_NON_ASCII), F.array_join(folded, "")).otherwise(value)


# The dots of such a run, one by one: a dot after a lone capital that another dotted capital follows or
# precedes, and one dot more right after a run. Looking around each dot needs no callback.
_RUN_DOT = (
    r"\.(?:(?<=\b[A-Z]\.)(?=[A-Z]\.)|(?<=\b[A-Z]\.[A-Z]\.)|(?<=\b[A-Z]\.[A-Z]\.\.))"
)


def join_dotted_capitals(value: Column) -> Column:
    """Drop the dots of dotted acronyms only. Expects upper-case ASCII text."""
    return F.regexp_replace(value, _RUN_DOT, "")


def strict_name_key(name: Column) -> Column:
    """Typography-insensitive key that keeps legal suffixes apart (LLP is not LP)."""
    upper = F.upper(ascii_fold(name))
    spelled = F.replace(join_dotted_capitals(upper), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(spelled, "[^A-Z0-9]+", " "))


def suffix_of_strict_key(strict_key: Column) -> Column:
    """Strict key without its trailing legal-form words; may become empty."""
    return F.regexp_replace(strict_key, rf"(?:(?:^| )(?:{'|'.join(LEGAL_SUFFIXES)}))+\z", "")


def suffix_candidate_key(name: Column) -> Column:
    return suffix_of_strict_key(strict_name_key(name))


def canonical_field_name(header: Column) -> Column:
    """One spelling for display and API column names: ``Vendor/Customer #`` is vendor_customer."""
    joined = F.regexp_replace(F.lower(ascii_fold(header)), "[^a-z0-9]+", "_")
    return F.btrim(joined, F.lit("_"))


def canonical_header_name(header: str) -> str:
    """The same spelling for the handful of header cells the driver sees when it plans a scan."""
    folded = unicodedata.normalize("NFKD", header).encode("ascii", "ignore").decode("ascii").lower()
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in folded).split()
    return "_".join(words)


def has_code_prefix(code: Column, prefixes: Iterable[str]) -> Column:
    """True when a code starts with one of the placeholder prefixes, case and padding aside."""
    normalized = F.upper(strip(code))
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | normalized.startswith(prefix.upper())
    return hit
