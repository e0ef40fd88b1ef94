"""Amounts and dates, parsed from the source text without rewriting it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import strip

AMOUNT_TYPE = "decimal(38,6)"

# The date spellings open-data exports use.
_US_DATE = r"^(\d{1,2})/(\d{1,2})/(?!0000)(\d{4})$"
_US_CLOCK = r"^\d{1,2}/\d{1,2}/(?!0000)\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}\s+[AaPp][Mm]$"
_YMD = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"
_ISO = (
    r"^(?!0000)\d{4}(?:-\d{2}-\d{2}|\d{4})"
    r"(?:[^0-9]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
)
# The commonest spelling, which needs nothing but its zone.
_ISO_PLAIN = r"^(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?$"
_ISO_ZONED = r"^\d{4}(?:-\d{2}-\d{2}|\d{4})[^0-9]\d{2}.*(?:Z|[+-]\d{2}(?::?\d{2})?)$"


def parse_amount(value: Column) -> Column:
    """Exact decimal of ``$1,234.50``; blank or unreadable text counts as zero."""
    bare = strip(F.translate(value, "$,", ""))
    return F.coalesce(bare.try_cast(AMOUNT_TYPE), F.lit(0).cast(AMOUNT_TYPE))


def _iso_timestamp(value: Column) -> Column:
    dated = F.regexp_replace(value, r"^(\d{4})-?(\d{2})-?(\d{2})", "$1-$2-$3")
    clocked = F.regexp_replace(
        dated, r"^(.{10})[^0-9](\d{2}):?(\d{2})?:?(\d{2})?", "$1T$2:$3:$4"
    )
    filled = F.regexp_replace(clocked, r":(?=[:+Z-]|$)", ":00")
    trimmed = F.regexp_replace(filled, r"[.,](\d{1,6})\d*", ".$1")
    zoned = F.regexp_replace(trimmed, r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.regexp_replace(zoned, r"(T[^+-]*[+-]\d{2})$", "$1:00")
    complete = (
        F.when(~zoned.contains("T"), F.concat(zoned, F.lit("T00:00:00Z")))
        .when(zoned.rlike(r"T.*(?:Z|[+-]\d{2}:\d{2})$"), zoned)
        .otherwise(F.concat(zoned, F.lit("Z")))
    )
    plain = F.concat(value, F.lit("Z"))
    return F.when(value.rlike(_ISO_PLAIN), plain).when(value.rlike(_ISO), complete).try_cast("timestamp")


def parse_date(value: Column) -> Column:
    """Instant of a stripped date text, tried as US date, US date with clock, then ISO; else null.

    Text without an offset is UTC. The instant does not depend on the session time zone.
    """
    us_date = F.when(
        value.rlike(_US_DATE), F.regexp_replace(value, _US_DATE, "$3-$1-$2T00:00:00Z")
    ).try_cast("timestamp")
    us_clock = F.when(
        value.rlike(_US_CLOCK),
        F.try_to_timestamp(
            F.concat(F.regexp_replace(value, r"\s+", " "), F.lit(" +00:00")),
            F.lit("M/d/yyyy h:m:s a XXX"),
        ),
    )
    ymd = F.when(value.rlike(_YMD), F.concat(value, F.lit("T00:00:00Z"))).try_cast("timestamp")
    return F.coalesce(us_date, us_clock, ymd, _iso_timestamp(value))


def is_suspicious(instant: Column, as_of_year: int) -> Column:
    """Year before 1900 or more than twenty years past ``as_of_year``."""
    first = F.lit("1900-01-01T00:00:00Z").cast("timestamp")
    after = F.lit(f"{as_of_year + 21:04d}-01-01T00:00:00Z").cast("timestamp")
    return (instant < first) | (instant >= after)


def is_aware_timestamp(value: Column) -> Column:
    """ISO 8601 text that names its own offset."""
    return F.coalesce(value.rlike(_ISO_ZONED) & _iso_timestamp(value).isNotNull(), F.lit(False))
