"""Chat formatting: a state machine over roles, driven by a declarative template.

Turns are brought together by conversation and walked in order by one task,
which holds the state of one conversation at a time and never the turns of it:
a conversation of any length passes through in constant memory.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which of them are learned, and which order is allowed.

    ``follows`` maps a state (``start`` or the last role) to the roles that may
    come next; ``final`` are the states in which a conversation may end.

    Texts are escaped by a backslash between the first two characters of a
    mark, so these must differ, and be neither a backslash nor a line break:
    other marks are refused.
    """

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    final: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def __post_init__(self) -> None:
        for mark in (self.begin, self.end):
            if len(mark) < 2 or mark[0] == mark[1] or {"\\", "\n"} & set(mark[:2]):
                raise ValueError(f"the mark {mark!r} cannot be escaped")


@lru_cache(maxsize=16)
def _openings(begin: str, end: str) -> tuple[re.Pattern, re.Pattern]:
    """The openings of the marks, with any escapes inside: plain, and with one at least."""
    openings = sorted({mark[:2] for mark in (begin, end)})
    found = [
        "|".join(rf"(?<={re.escape(o[0])}){escapes}(?={re.escape(o[1])})" for o in openings) for escapes in (r"(?:\\*)", r"\\(?:\\*)")
    ]
    return re.compile(found[0]), re.compile(found[1])


def escape(text: str, template: Template | None = None) -> str:
    """``text`` without any mark of the template: one more backslash stands in each opening."""
    t = template or Template()
    return _openings(t.begin, t.end)[0].sub(lambda m: m[0] + "\\", text)


def unescape(text: str, template: Template | None = None) -> str:
    t = template or Template()
    return _openings(t.begin, t.end)[1].sub(lambda m: m[0][1:], text)


def escape_role(role: str, template: Template | None = None) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"), template)


def unescape_role(role: str, template: Template | None = None) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role, template))


SEGMENTS = (
    "conv_id long, position long, text string, loss boolean, "
    "state string, valid boolean, last boolean"
)
_SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("text", pa.string()),
        ("loss", pa.bool_()),
        ("state", pa.string()),
        ("valid", pa.bool_()),
        ("last", pa.bool_()),
    ]
)
# Characters of text after which a batch of segments is passed on.
_BATCH_CHARS = 4 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 64 + (len(row[text_at]) if text_at is not None else 0)
        if chars >= _BATCH_CHARS:
            yield pa.record_batch([list(c) for c in zip(*held, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.record_batch([list(c) for c in zip(*held, strict=True)], schema=schema)


def _segments(turns: Iterator[tuple], template: Template) -> Iterator[tuple]:
    """Three segments a turn: head, body, tail. Only learned bodies carry loss."""
    none = object()
    conv, state, valid, position = none, START, True, 0
    pending: tuple | None = None
    for conv_id, role, text in turns:
        if conv is none or conv_id != conv:
            if pending:
                yield (*pending[:-2], valid and state in template.final, True)
            conv, state, valid, position = conv_id, START, True, 0
        elif pending:
            yield pending
        role, text = role or "", text or ""
        valid = valid and role in template.follows.get(state, ())
        state = role
        yield conv_id, position, f"{template.begin}{escape_role(role, template)}\n", False, state, valid, False
        yield conv_id, position + 1, escape(text, template), role in template.learned, state, valid, False
        pending = (conv_id, position + 2, template.end + template.after, False, state, valid, False)
        position += 3
    if pending:
        yield (*pending[:-2], valid and state in template.final, True)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of each conversation: ``conv_id, position, text, loss, state, valid, last``.

    ``turns`` needs ``conv_id, turn, role, text``; other columns are ignored.
    The texts of a conversation in order of ``position`` are its formatted text,
    ``loss`` says which of them are learned. ``valid`` holds as long as every
    turn so far was allowed; on the ``last`` segment it also asks for a final
    state, so that row alone tells whether the conversation is well formed.
    Nothing is left out: broken conversations are formatted and marked.

    Turns go by ``turn`` (nulls first), equal ones by role and text; repeated
    rows are turns of their own. A null role or text is empty, a null
    ``conv_id`` is a conversation of its own. An empty table gives no rows.
    """
    template = template or Template()
    ordered = (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_segments(_rows(batches), template), _SEGMENTS, 2)

    return ordered.mapInArrow(run, SEGMENTS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, valid boolean"
)
_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ]
)


class _Reader:
    """Reads one conversation back from its formatted text, as it comes.

    Only marks and loss flags are used: what stands between a begin mark and
    the first line break is a role, what stands from there to an end mark is a
    text. Marks may be cut anywhere between two feeds.
    """

    def __init__(self, conv_id, template: Template) -> None:
        self.conv_id, self.template = conv_id, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid = True
        self.rest, self.inside = "", False
        self.position = 0

    def feed(self, position: int, text: str, loss: bool, valid: bool, last: bool) -> None:
        t = self.template
        if position != self.position:
            raise ValueError(f"conversation {self.conv_id}: segment {self.position} was expected, not {position}")
        self.position += 1
        self.chars += len(text)
        self.valid = valid
        if loss:
            plain = unescape(text, t)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.rest += text
        while True:
            if not self.inside:
                if not self.rest.startswith(t.begin) or "\n" not in self.rest:
                    break
                role, self.rest = self.rest[len(t.begin) :].split("\n", 1)
                self.turns.update(unescape_role(role, t).encode() + b"\n")
                self.inside = True
            body, found, rest = self.rest.partition(t.end + t.after)
            if not found:
                break
            self.turns.update(unescape(body, t).encode() + b"\n")
            self.n_turns += 1
            self.rest, self.inside = rest, False
        if last and (self.rest or self.inside):
            raise ValueError(f"conversation {self.conv_id}: text left over after the last turn")

    def row(self) -> tuple:
        return (
            self.conv_id,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
            self.valid,
        )


def read_chats(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Read formatted conversations back: one row of digests for each.

    ``segments`` is the result of ``format_chats`` as it comes (each
    conversation in one partition and in order); nothing is shuffled. Segments
    that come in another order, or not all, fail the job. An empty table gives
    an empty table.
    """
    template = template or Template()

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        reader = None
        for conv_id, position, text, loss, _, valid, last in rows:
            reader = reader or _Reader(conv_id, template)
            if conv_id != reader.conv_id:
                raise ValueError(f"conversation {reader.conv_id} has no last segment")
            reader.feed(position, text, loss, valid, last)
            if last:
                yield reader.row()
                reader = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digests(_rows(batches)), _DIGESTS, None)

    return segments.mapInArrow(run, DIGESTS)
