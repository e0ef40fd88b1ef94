"""Chat formatting: conversations rendered by a compiled template, and read back.

``CONVERSATION`` is the template of a whole conversation: a loop over its turns, with what stands before, between and
behind them. It marks turns, escapes control strings inside roles and texts so that they can be told from marks and
undone, and puts the text of assistant turns between generation marks, which become the spans of the loss mask.

Rows are dealt by conversation and sorted in their tasks. A task renders them one by one, looking one row ahead to know
the last turn, so that not even a conversation that holds a third of all rows is gathered (its time is one task's). A
formatted conversation is its rows in order; each row tells where its text starts in it. Reading back goes the same way,
and folds the turns into running hashes.

Defined results: a null text or role counts as empty; turns are ordered by number, nulls last, then by role and text,
so repeated rows count as often as they occur; rows without a conversation id form one conversation; ids that are not
whole numbers are refused before anything runs; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from recordloom.llm.chat_template import compile_stream
from recordloom.session import ship_package

#: Control strings of the format. A backslash before one of them, or before a backslash, takes its meaning away.
CONTROL = re.compile(r"\\|</?(?:turn|chat)>|### |: ")
MARKED = re.compile(r"<turn>### ((?:[^\\:]++|\\.|:(?! ))*+): ((?:[^\\<]++|\\.|<(?!/?turn>))*+)</turn>", re.S)
HEADER, BETWEEN, FOOTER = "<chat>\n", "\n", "\n</chat>\n"

TURN = """<turn>### {{ turn.role|escape|title }}: \
{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}\
{% else %}{{ turn.text|escape }}{% endif %}</turn>"""
CONVERSATION = """<chat>
{% for turn in turns %}""" + TURN + """{% if not loop.last %}
{% endif %}{% endfor %}
</chat>
"""

FORMATTED = "conv_id long, turn long, place long, start long, formatted string, spans array<struct<start: int, stop: int>>"
FORMATTED_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("place", pa.int64()),
        ("start", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
)
#: Rows are rendered and handed on in lists of so many.
ROWS = 256
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


#: Roles as the format shows them. Other roles are shown as they are.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
SHOWN = {v: k for k, v in ROLES.items()}


def title(role: str) -> str:
    """A known role's display name. A role that looks like one is marked by an escape, to stay apart from it."""
    return ROLES.get(role) or ("\\" + role if role in SHOWN else role)


def role_of(shown: str) -> str:
    return SHOWN.get(shown) or unescape(shown)


FILTERS = {"escape": escape, "title": title}


def _formatter(template: str):
    """A function from dealt and sorted batches of turns to their formatted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_stream(template, FILTERS, "turns")
        held = None  # the row before, until it is known whether it is a conversation's last
        place = start = 0
        rows = (row for batch in batches for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)) for row in part.to_pylist())
        out: list[dict] = []
        for row in itertools.chain(rows, [None]):
            if held is not None:
                last = row is None or row["conv_id"] != held["conv_id"]
                turn = {"role": held["role"] or "", "text": held["text"] or ""}
                text = render({"conv_id": held["conv_id"]}, turn, place, last)
                spans = [{"start": a, "stop": b} for a, b in text.spans]
                out.append({"conv_id": held["conv_id"], "turn": held["turn"], "place": place, "start": start, "formatted": text.text(), "spans": spans})
                place, start = (0, 0) if last else (place + 1, start + text.size)
            held = row
            if len(out) == ROWS:
                yield pa.RecordBatch.from_pylist(out, FORMATTED_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, FORMATTED_ARROW)

    return run


def format_conversations(turns: DataFrame, template: str = CONVERSATION) -> DataFrame:
    """Every row of ``turns`` (conv_id, turn, role, text) as its part of the formatted conversation.

    ``place`` is the row's place among the turns, ``start`` the code points of the conversation before it, ``spans`` the
    loss spans inside ``formatted``. The template loops over ``turns`` and may use ``conv_id``.
    """
    for name in ("conv_id", "turn"):
        if not isinstance(turns.schema[name].dataType, IntegralType):
            raise ValueError(f"{name} must be a whole number, not {turns.schema[name].dataType.simpleString()}")
    ship_package(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.mapInArrow(_formatter(template), FORMATTED)


class _Reader:
    """What is read back from the rows of one conversation."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.closed = False

    def add(self, start: int, formatted: str, spans) -> None:
        if start != self.formatted_chars:
            raise ValueError(f"{start} code points come before this turn, not {self.formatted_chars}")
        at = 0
        if not start:
            if not formatted.startswith(HEADER):
                raise ValueError(f"no header: {formatted[:80]!r}")
            at = len(HEADER)
        while at < len(formatted):
            match = None if self.closed else MARKED.match(formatted, at)
            if not match:
                raise ValueError(f"not a formatted turn: {formatted[at : at + 80]!r}")
            self.turns.update(f"{role_of(match[1])}\n{unescape(match[2])}\n".encode())
            self.n_turns += 1
            self.closed = formatted.startswith(FOOTER, match.end())
            at = match.end() + len(FOOTER if self.closed else BETWEEN)
        for span in spans:
            text = unescape(formatted[span["start"] : span["stop"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self, conv_id: int | None) -> dict:
        if not self.closed:
            raise ValueError(f"conversation {conv_id} has no end")
        return {
            "conv_id": conv_id,
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.formatted_chars,
        }


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation with what its formatted text says: turns, loss text and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = reader = None
        for batch in batches:
            done = []
            for own, start, text, spans in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "start", "formatted", "spans"))):
                if reader is None or own != key:
                    done += [reader.row(key)] if reader else []
                    key, reader = own, _Reader()
                reader.add(start, text, spans)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if reader:
            yield pa.RecordBatch.from_pylist([reader.row(key)], schema)

    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )
    ship_package(formatted.sparkSession)
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "start", "formatted", "spans").mapInArrow(run, READ)
