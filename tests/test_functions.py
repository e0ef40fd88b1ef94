import random
import re
import sys
import unicodedata
from decimal import Decimal
from itertools import dropwhile

import pytest
from pyspark.sql import functions as F

from recordloom.functions import pii, text, values

# The same five shapes in Python's regular-expression dialect.
PY_PATTERNS = (
    ("email", re.compile(r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I)),
    (
        "phone",
        re.compile(
            r"(?<!\d)(?:\+?1[\s./-]*)?(?:\(\s*\d{3}\s*\)|\d{3})[\s./-]*\d{3}[\s./-]*\d{4}(?!\d)"
        ),
    ),
    ("ssn", re.compile(r"(?<!\d)\d{3}[ -]\d{2}[ -]\d{4}(?!\d)")),
    (
        "po_box",
        re.compile(r"\bP(?:OST(?:AL)?)?\.?\s*O(?:FFICE)?\.?\s+BOX\s+\d+[A-Z0-9-]*\b", re.I),
    ),
    (
        "street",
        re.compile(
            r"\b\d{1,6}\s+(?:[A-Z0-9.'-]+\s+){0,5}(?:ST(?:REET)?|AVE(?:NUE)?|RD|ROAD|BLVD|"
            r"BOULEVARD|DR|DRIVE|LN|LANE|CT|COURT|WAY|PL|PLACE|PKWY|PARKWAY)\b",
            re.I,
        ),
    ),
)


def plain_capitals(name):
    """The characters of a name that have an ASCII base, as capitals."""
    bases = (unicodedata.normalize("NFKD", char) for char in name)
    return "".join(part for base in bases for part in base if part < "\x80").upper()


def dotted_run(chars, at):
    """Length of the dotted capitals that begin at ``at``: at least two of letter and dot, then perhaps a letter, a dot."""
    inside = at > 0 and (chars[at - 1].isalnum() or chars[at - 1] == "_")
    pairs = 0
    while not inside and chars[at + 2 * pairs : at + 2 * pairs + 1] in CAPITALS and chars[at + 2 * pairs + 1 : at + 2 * pairs + 2] == ".":
        pairs += 1
    if pairs < 2:
        return 0
    end = at + 2 * pairs
    end += chars[end : end + 1] in CAPITALS
    end += chars[end : end + 1] == "."
    return end - at


CAPITALS = {chr(c) for c in range(ord("A"), ord("Z") + 1)}


def without_dots(chars):
    out, at = [], 0
    while at < len(chars):
        length = dotted_run(chars, at)
        out += [c for c in chars[at : at + length] if c != "."] or [chars[at]]
        at += max(length, 1)
    return "".join(out)


def name_words(name):
    """The words of a name key: runs of capitals and digits, ``&`` being the word AND."""
    words, word = [], ""
    for char in without_dots(plain_capitals(name)) + " ":
        if char in CAPITALS or char in "0123456789":
            word += char
            continue
        words += [word] if word else []
        words += ["AND"] if char == "&" else []
        word = ""
    return words


def without_suffixes(words):
    return list(dropwhile(lambda word: word in text.LEGAL_SUFFIXES, reversed(words)))[::-1]


def column(spark, samples):
    return spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i long, v string")


def apply(spark, samples, *exprs):
    df = column(spark, samples)
    rows = df.select("i", *[e(F.col("v")).alias(f"c{k}") for k, e in enumerate(exprs)]).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


def test_name_key_examples(spark):
    got = apply(
        spark,
        ["Café A&B, L.L.C.", "Husch Blackwell LLP", "Husch Blackwell LP", "INC", "XCO", "a.b. c"],
        text.strict_name_key,
        text.suffix_candidate_key,
    )
    assert got[0][0] == "CAFE A AND B LLC"
    assert got[1][0] != got[2][0]
    assert got[1][1] == got[2][1] == "HUSCH BLACKWELL"
    assert got[3][1] == "" and got[4][1] == "XCO"


def test_placeholder_codes(spark):
    got = apply(spark, [" mis0000222 ", "0000222"], lambda c: text.has_code_prefix(c, ("MIS",)))
    assert got == [(True,), (False,)]


def test_canonical_names(spark):
    names = ["Contribution Amount", "Vendor/Customer #", "Añada  Ⅳ", "__x__", "%%"]
    got = [row[0] for row in apply(spark, names, text.canonical_field_name)]
    assert got == ["contribution_amount", "vendor_customer", "anada_iv", "x", ""]
    assert got == [text.canonical_header_name(n) for n in names]


def test_strip_equals_python(spark):
    pad = [chr(p) for p in range(sys.maxunicode + 1) if chr(p).isspace()]
    samples = [p + "x y" + p + p for p in pad] + ["", " ", "　\n", "​x"]
    assert [row[0] for row in apply(spark, samples, text.strip)] == [s.strip() for s in samples]


def test_fold_every_code_point(spark):
    points = [chr(p) for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    interesting = [c for c in points if unicodedata.normalize("NFKD", c) != c]
    chunks = ["|".join(interesting[i : i + 50]) for i in range(0, len(interesting), 50)]
    want = [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in chunks]
    assert [row[0] for row in apply(spark, chunks, text.ascii_fold)] == want


def test_name_keys_fuzz(spark):
    rng = random.Random(5)
    alphabet = list("ABLCabc..&,-' \t\x01\x02") + ["LLC", " Inc", "é", "½", "ﬁ", "ß", "Å", "ⓐ", "中", "U.S.A."]
    samples = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(8000)]
    got = apply(spark, samples, text.strict_name_key, text.suffix_candidate_key)
    assert got == [(" ".join(name_words(s)), " ".join(without_suffixes(name_words(s)))) for s in samples]


def test_dotted_capitals_fuzz(spark):
    rng = random.Random(9)
    samples = ["".join(rng.choices("AABC...1_ &X", k=rng.randint(0, 16))) for _ in range(30000)]
    got = [row[0] for row in apply(spark, samples, text.join_dotted_capitals)]
    assert got == [without_dots(s) for s in samples]


#: Values of our own, several of each kind.
SHAPED = {
    "email": ["write to desk.7@mill-town.org today", "A_B%c@x.io", "ask: q+1@sub.example.net"],
    "phone": ["ring 206 555 0143 after nine", "(206) 555.0143", "+1-206-555-0143", "2065550143x"],
    "ssn": ["no. 219-09-9999 on file", "219 09 9999"],
    "street_address": ["leave it at 9 Old Mill Rd", "77 N. Harbour View Blvd, rear", "POST OFFICE BOX 31", "p.o. box 5a"],
}
PLAIN = ["Mill Town Water Board", "version 12.5 of 2031", "room 404", "at sign @ alone", "12-34-56", "box of 12 boxes"]


def test_pii_examples(spark):
    samples = [(value, kind) for kind, listed in SHAPED.items() for value in listed] + [(value, None) for value in PLAIN]
    hits = pii.pattern_hits(F.col("v"))
    rows = column(spark, [value for value, _ in samples]).select("i", *[hit.alias(f"p{p}") for p, _, hit in hits]).collect()
    for row in rows:
        value, kind = samples[row["i"]]
        assert {k for p, k, _ in hits if row[f"p{p}"]} == ({kind} - {None}), value
    assert [r[0] for r in apply(spark, [v for v, _ in samples], pii.contains_pii)] == [k is not None for _, k in samples]
    # Digits in an identifier column are no phone number and no SSN.
    numbers = SHAPED["phone"] + SHAPED["ssn"]
    assert not any(r[0] for r in apply(spark, numbers, lambda c: pii.contains_pii(c, "vendor_key")))


def test_pii_fuzz(spark):
    rng = random.Random(11)
    pieces = [
        "1", "2", "12", "345", "6789", "512", "0199", "+1", "(", ")", "-", ".", "/", " ", "\t", "\x1d",
        " ", "P", "O", "po", "Post", "Office", "BOX", "Box 12", "st", "ST", "Street", "ave", "rd",
        "way", "@", "a", "Bc", ".com", "é", "́", "٠", "K", "ſ", "½", "_", "'", "%", "中",
        "123 Main", "a@b", "ſt", "\n",
    ]
    samples = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(20000)]
    df = column(spark, samples)
    rows = df.select("i", *[h.alias(f"p{p}") for p, _, h in pii.pattern_hits(F.col("v"))]).collect()
    wrong = []
    for row in rows:
        sample = samples[row["i"]]
        for position, (name, pattern) in enumerate(PY_PATTERNS):
            if bool(pattern.search(sample)) != row[f"p{position}"]:
                wrong.append((name, sample))
    assert not wrong, wrong[:5]


AMOUNTS = {
    "$1,234.50": "1234.50", "": "0", "  ": "0", "(5.00)": "0", "1e3": "1000", "-7": "-7", " $ 8 ": "8", "abc": "0",
    "+.5": "0.5", "1.2.3": "0", "0.000001": "0.000001", "$-3.1": "-3.1", "$": "0", "12,34,567": "1234567",
}


def test_amounts(spark):
    got = apply(spark, list(AMOUNTS), values.parse_amount)
    assert [row[0] for row in got] == [Decimal(v) for v in AMOUNTS.values()]


# Text to instant (UTC); None cannot be read.
DATES = {
    "01/01/2026": "2026-01-01T00:00:00.000000",
    "12/31/2025": "2025-12-31T00:00:00.000000",
    "1/2/2026": "2026-01-02T00:00:00.000000",
    "12/02/0023": "0023-12-02T00:00:00.000000",
    "01/01/26": None,
    "13/01/2026": None,
    "02/30/2026": None,
    "11/06/2104": "2104-11-06T00:00:00.000000",
    "01/02/2026 01:02:03 PM": "2026-01-02T13:02:03.000000",
    "1/2/2026 12:00:00 am": "2026-01-02T00:00:00.000000",
    "01/02/2026 13:00:00 PM": None,
    "01/02/2026 00:10:00 AM": None,
    "2026-01-02": "2026-01-02T00:00:00.000000",
    "2026-1-2": "2026-01-02T00:00:00.000000",
    "2026": None,
    "2026-01": None,
    "12:30": None,
    "20260102": "2026-01-02T00:00:00.000000",
    "0000-01-01": None,
    "2026-01-02T03:04:05": "2026-01-02T03:04:05.000000",
    "2026-01-02T03:04:05.123456": "2026-01-02T03:04:05.123456",
    "2026-01-02 03:04": "2026-01-02T03:04:00.000000",
    "2026-01-02T03": "2026-01-02T03:00:00.000000",
    "2026-01-02T03:04:05Z": "2026-01-02T03:04:05.000000",
    "2026-01-02T03:04:05+05:30": "2026-01-01T21:34:05.000000",
    "2026-01-02T03:04-0500": "2026-01-02T08:04:00.000000",
    "2026-01-02T03+05": "2026-01-01T22:00:00.000000",
    "2026-01-02T030405": "2026-01-02T03:04:05.000000",
    "20260102T0304": "2026-01-02T03:04:00.000000",
    "2026-01-02T03:04:05,5": "2026-01-02T03:04:05.500000",
    "2026-01-02T03:04:05.1234567": "2026-01-02T03:04:05.123456",
    "junk": None,
    "2026-01-02T": None,
    "2026-01-02T25:00": None,
    "2026-01-02x03:04": "2026-01-02T03:04:00.000000",
    "01/02/2026 1:2:3 PM": "2026-01-02T13:02:03.000000",
    "2024-02-29": "2024-02-29T00:00:00.000000",
    "2023-02-29": None,
    "01/02/2026  01:02:03  PM": "2026-01-02T13:02:03.000000",
    "2026-01-02T03:04:05.1": "2026-01-02T03:04:05.100000",
    "2026-01-02T03:04Z": "2026-01-02T03:04:00.000000",
    "1/2/0000": None,
    "2026/01/02": None,
}
AWARE = {
    "2026-01-02T03:04:05Z",
    "2026-01-02T03:04:05+05:30",
    "2026-01-02T03:04-0500",
    "2026-01-02T03+05",
    "2026-01-02T03:04Z",
    "2026-08-18T14:30-05:00",
    "2026-08-18T14:30:00-05:00",
}


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_dates(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = apply(spark, list(DATES), lambda c: F.unix_micros(values.parse_date(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = spark.createDataFrame([(i, at) for i, at in enumerate(DATES.values())], "i long, at string")
    want = want.select("i", F.unix_micros(F.to_timestamp("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).orderBy("i").collect()
    wrong = [(s, g[0], w[1]) for s, g, w in zip(DATES, got, want) if g[0] != w[1]]
    assert not wrong, wrong


def test_aware_timestamps(spark):
    samples = [*DATES, *(AWARE - DATES.keys())]
    got = apply(spark, samples, values.is_aware_timestamp)
    assert {s for s, g in zip(samples, got) if g[0]} == AWARE


def test_suspicious_years(spark):
    samples = ["12/02/0023", "11/06/2104", "01/01/1900", "12/31/1899", "12/31/2046", "01/01/2047"]
    got = apply(spark, samples, lambda c: values.is_suspicious(values.parse_date(c), 2026))
    assert [row[0] for row in got] == [True, True, False, True, False, True]
