"""Contact- and address-shaped text. Nothing in this module returns the text that matched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware word character, digit, white space and word boundary, spelled out because the JVM's
# shorthand classes differ from the ones the patterns were written for.
_W = r"[\p{L}\p{N}_]"
_D = r"\p{Nd}"
_S = r"[\p{IsWhite_Space}\x1c-\x1f]"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# A look at the first character alone, which rejects most positions before anything slower runs.
_DIGIT_AHEAD = r"(?=[0-9]|[^\x00-\x7F])"
_PHONE_AHEAD = r"(?=[0-9+(]|[^\x00-\x7F])"

# Both letter ranges are written out: case-insensitive matching alone misses the Kelvin sign and dotted I.
# What counts as an e-mail, phone number, SSN, P.O. box or street address.
EMAIL = rf"(?iu){_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(?!{_W})"
PHONE = (
    rf"{_PHONE_AHEAD}(?<!{_D})(?:\+?1[\p{{IsWhite_Space}}\x1c-\x1f./-]*)?(?:\({_S}*{_D}{{3}}{_S}*\)|{_D}{{3}})"
    rf"[\p{{IsWhite_Space}}\x1c-\x1f./-]*{_D}{{3}}[\p{{IsWhite_Space}}\x1c-\x1f./-]*{_D}{{4}}(?!{_D})"
)
SSN = rf"{_DIGIT_AHEAD}(?<!{_D}){_D}{{3}}[ -]{_D}{{2}}[ -]{_D}{{4}}(?!{_D})"
PO_BOX = (
    rf"(?iu)(?=[Pp])(?<!{_W})P(?:OST(?:AL)?)?\.?{_S}*O(?:FFICE)?\.?{_S}+BOX{_S}+{_D}+[A-Za-z0-9-]*{_EDGE}"
)
STREET = (
    rf"(?iu){_DIGIT_AHEAD}(?<!{_W}){_D}{{1,6}}{_S}+(?:[A-Za-z0-9.'-]+{_S}+){{0,5}}"
    r"(?:ST(?:REET)?|AVE(?:NUE)?|RD|ROAD|BLVD|BOULEVARD|DR|DRIVE|LN|LANE|"
    rf"CT|COURT|WAY|PL|PLACE|PKWY|PARKWAY)(?!{_W})"
)
PATTERNS = (
    ("email", EMAIL),
    ("phone", PHONE),
    ("ssn", SSN),
    ("street_address", PO_BOX),
    ("street_address", STREET),
)
# Name parts that mark a column as an opaque identifier.
IDENTIFIER_PARTS = frozenset({"cd", "code", "id", "key", "no", "number"})
REDACTED = "[redacted]"


#: Every pattern but the e-mail address needs a decimal digit, which most texts lack.
_DIGIT = rf"{_D}"


def has_digit(value: Column) -> Column:
    return value.rlike(_DIGIT)


def is_identifier_field(field: str) -> bool:
    """Digits in such a column are an identifier, not a phone number or SSN."""
    return not IDENTIFIER_PARTS.isdisjoint(field.split("_"))


def pattern_hits(value: Column, field: str = "") -> list[tuple[int, str, Column]]:
    """(pattern position, kind, predicate) for every pattern that applies to a column."""
    exempt = {"phone", "ssn"} if is_identifier_field(field) else set()
    hits = []
    for position, (kind, pattern) in enumerate(PATTERNS):
        if kind in exempt:
            continue
        hit = value.rlike(pattern)
        if kind == "email":
            hit = value.contains("@") & hit
        hits.append((position, kind, hit))
    return hits


def contains_pii(value: Column, field: str = "") -> Column:
    email, numbered = F.lit(False), F.lit(False)
    for _, kind, hit in pattern_hits(value, field):
        if kind == "email":
            email = email | hit
        else:
            numbered = numbered | hit
    return email | (has_digit(value) & numbered)
