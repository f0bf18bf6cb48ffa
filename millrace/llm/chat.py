"""Chat formatting by incremental black-box rendering."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Message = tuple[str, str]  # role, text
Render = Callable[[list[Message]], str]


class RewritesHistory(ValueError):
    """A template changed what it had written for earlier turns."""


#: Role names that the marker template writes as given here; any other role is written with = in front.
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
_BACK = {v: k for k, v in ROLES.items()}
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)


def escape(s: str) -> str:
    """A backslash before every backslash, # and the < of </turn>, so that no control
    string is left in a text."""
    return re.sub(r"[\\#]|<(?=/turn>)", r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


#: Turns that were shown last, emptied beyond so many characters, as prefixes repeat them.
SHOWN_CHARS = 8_000_000
_shown: dict[Message, str] = {}
_shown_chars = 0


def _show(message: Message) -> str:
    global _shown_chars
    role, text = message
    if _shown_chars > SHOWN_CHARS:
        _shown.clear()
        _shown_chars = 0
    out = _shown[message] = f"### {ROLES.get(role) or '=' + escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n"
    _shown_chars += len(role) + len(text) + len(out)
    return out


def marker_template(messages: list[Message]) -> str:
    """Turns one after another, none of which depends on another (``looks_back=0``)."""
    return "".join([_shown.get(m) or _show(m) for m in messages])


def read_turn(span: str) -> Message:
    """Role and text of one formatted turn of the marker template."""
    m = _TURN.fullmatch(span)
    if not m:
        raise ValueError(f"not a formatted turn: {span[:80]!r}")
    role = m[1]
    return (unescape(role[1:]) if role[0] == "=" else _BACK[role]), unescape(m[2])


def _sentinels(shown: str, n: int = 3) -> Iterator[str]:
    """The first private-use characters that are nowhere in an output."""
    return islice((c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0xF2000))) if c not in shown), n)


class TurnLocator:
    """Locates turns in a black-box template's output. Each added turn is rendered
    with the turns before it; the output without it must be a prefix, and what
    follows is the turn's span. A second rendering with a sentinel, a character the
    output has not, for its text shows where in the span the text lies.

    Whole prefixes are rendered, so any change of earlier output is found at the turn
    that makes it. A template that promises to look at no more than the ``looks_back``
    turns before one is rendered from there, which makes a long conversation's cost
    linear."""

    def __init__(self, render: Render, looks_back: int | None = None):
        self.render, self.looks_back = render, looks_back
        self.turns: list[Message] = []
        self.out = ""

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn's span, and where the text begins and ends in it."""
        if self.looks_back is not None and len(self.turns) > self.looks_back:
            self.turns = self.turns[len(self.turns) - self.looks_back :]
            self.out = self.render(self.turns) if self.turns else ""
        before, earlier = self.out, self.turns
        self.turns = [*earlier, (role, text)]
        self.out = self.render(self.turns)
        if not self.out.startswith(before):
            raise RewritesHistory(f"turn {len(self.turns)} changes the output of earlier turns")
        span = self.out[len(before) :]
        for mark in _sentinels(self.out):
            shown = self.render([*earlier, (role, mark)])
            if shown.startswith(before) and shown.count(mark, len(before)) == 1:
                head = shown.index(mark, len(before)) - len(before)
                tail = len(shown) - len(before) - head - 1
                return span, head, len(span) - tail
        raise RewritesHistory("a turn's text is not shown exactly once")


def locate_turns(render: Render, messages: list[Message], looks_back: int | None = None) -> list[tuple[str, int, int]]:
    """Span and text place of every turn of a whole conversation.

    Without ``looks_back`` every prefix is rendered whole, whatever its length: exact
    for any template, at a cost that grows with the square of a conversation. With it,
    the promise is held against the template: the joined spans must be the rendering of
    all turns at 1, 2, 4, ... turns and at the end, or RewritesHistory is raised."""
    turns = TurnLocator(render, looks_back)
    found = [turns.add(*m) for m in messages]
    if looks_back is not None and messages:
        n = 1
        while True:
            if render(messages[:n]) != "".join(s for s, _, _ in found[:n]):
                raise RewritesHistory(f"the template looks back over more than {looks_back} turns")
            if n == len(messages):
                break
            n = min(2 * n, len(messages))
    return found


TURNS = "conv_id long, position long, span string, start long, loss_start long, loss_end long"


def format_turns(conversations: DataFrame, render: Render = marker_template, learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", looks_back: int | None = None) -> DataFrame:
    """One row per turn: conv_id, position (0, 1, ...), span (its part of the
    conversation's formatted text), start (where the span begins in it), and the
    part of the formatted text under the loss mask (null for roles not learned).

    Every prefix of a conversation is rendered whole unless the template promises how
    far it ``looks_back`` (see ``locate_turns``); RewritesHistory ends the job where a
    template changes earlier output. One shuffle by conversation; a task streams its
    sorted rows and holds one batch and one conversation. Rows of a conversation stay together and in order. Null text or role:
    empty. Null turn: first. Turns of one number: by role, then text. Repeated rows:
    one turn each. Null conv_id: one conversation. Empty table: no rows. Other
    columns are not read."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run  # no conversation
        held: list[Message] = []
        rows: list[tuple] = []

        def solve(least: int) -> Iterator[pa.RecordBatch]:
            """Adds the held conversation; gives rows out if there are ``least``."""
            start = 0
            for position, ((role, _), (span, head, end)) in enumerate(zip(held, locate_turns(render, held, looks_back))):
                loss = role in learn
                rows.append((at, position, span, start, start + head if loss else None, start + end if loss else None))
                start += len(span)
            held.clear()
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            if len(rows) >= least:
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 10_000]), types)], names=[x.split()[0] for x in TURNS.split(", ")])
                rows.clear()

        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if conv != at:
                    yield from solve(5000)
                    at = conv
                held.append((role, text))
        yield from solve(1)

    return dealt.mapInArrow(run, TURNS)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_turns(turns: DataFrame, read: Callable[[str], Message] = read_turn) -> DataFrame:
    """One row per conversation, read back from the formatted spans of
    ``format_turns``, whose grouping and order it relies on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run
        n = chars = size = 0
        all_h, loss_h = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []
        close = lambda: done.append((at, n, all_h.hexdigest(), chars, loss_h.hexdigest(), size)) if n else None
        for b in batches:
            for conv, span, start, lo, hi in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if conv != at:
                    close()
                    at, n, chars, size, all_h, loss_h = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text = read(span)
                all_h.update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    part = unescape(span[lo - start : hi - start])
                    loss_h.update(part.encode())
                    chars += len(part)
                n, size = n + 1, size + len(span)
            if done:
                yield _digest_batch(done)
                done.clear()
        close()
        if done:
            yield _digest_batch(done)

    return turns.mapInArrow(run, DIGEST)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=[x.split()[0] for x in DIGEST.split(", ")])
