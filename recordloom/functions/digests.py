"""Identifiers and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDIDATE_ID = "^[0-9a-f]{16}$"
SHA256_HEX = "^[0-9a-f]{64}$"


def candidate_id(campaign_key: Column, public_key: Column, source: Column, code: Column) -> Column:
    joined = F.concat_ws("|", campaign_key, public_key, source, code)
    return F.substring(F.sha2(joined, 256), 1, 16)


def row_fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the compact JSON object of ``columns`` with sorted keys.

    Spark's JSON writer spells control escapes in upper-case hex; the fingerprint is defined on
    lower case, so the six letters are lowered where the backslash really starts an escape.
    """
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sorted(columns)]
    text = F.to_json(F.struct(*values))
    lowered = text
    for letter in "ABCDEF":
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u00([01]){letter}", rf"$1\\u00$2{letter.lower()}"
        )
    return F.sha2(F.when(text.contains("\\u00"), lowered).otherwise(text), 256)
