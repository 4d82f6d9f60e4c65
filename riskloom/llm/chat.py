"""Chat formatting from an event log.

Conversations arrive as events. They are dealt by conversation, sorted by sequence number and folded in one pass: each
message collects its deltas, an edit replaces its text, a regeneration empties it and drops what followed it, a removal
takes it out. The final messages are rendered with a template whose control strings are escaped inside texts, together
with the spans that the loss covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame

OPEN, BODY, CLOSE = "### ", "\n", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|\n")
_ESCAPE = re.compile(r"\\(\\|###|</turn>|\n)")
_TURN = re.compile(r"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)

EVENTS = "conv long, seq long, message string, kind string, role string, text string"


def escape(text: str) -> str:
    """``text`` with a backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1], text)


def render(messages: Sequence[tuple[str, str]], learned: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans, in code points, of the texts whose role is learned."""
    out, at, spans = [], 0, []
    for role, text in messages:
        head = OPEN + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + BODY
        body = escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages (role, text) of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn begins at {at}")
        out.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return out


class Conversation:
    """The messages of one conversation while its events are folded."""

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}
        self._anonymous = count()

    def apply(self, message: str | None, kind: str | None, role: str | None, text: str | None) -> None:
        key = ("anonymous", next(self._anonymous)) if message is None else message
        if kind == "remove":
            self.messages.pop(key, None)
            return
        if kind not in ("message", "delta", "edit", "regenerate"):
            raise ValueError(f"no such kind of event: {kind}")
        if kind == "regenerate" and key in self.messages:
            keys = list(self.messages)
            for later in keys[keys.index(key) + 1 :]:
                del self.messages[later]
        own = self.messages.setdefault(key, [role, []])
        own[0] = own[0] if role is None else role
        if kind != "delta":
            own[1].clear()
        own[1].append(text or "")

    def final(self) -> list[tuple[str, str]]:
        return [(role or "", "".join(parts)) for role, parts in self.messages.values()]


def _folded(learned: frozenset[str]):
    def row(conv: int | None, conversation: Conversation) -> dict:
        messages = conversation.final()
        formatted, spans = render(messages, learned)
        return {"conv": conv, "n_turns": len(messages), "formatted": formatted, "loss": [{"from": a, "to": b} for a, b in spans]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("from", pa.int32()), ("to", pa.int32())])
        schema = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(span))])
        current, conversation = None, None
        for batch in batches:
            done = []
            for conv, message, kind, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if conversation is None or conv != current:
                    if conversation is not None:
                        done.append(row(current, conversation))
                    current, conversation = conv, Conversation()
                conversation.apply(message, kind, role, text)
            yield pa.RecordBatch.from_pylist(done, schema)
        if conversation is not None:
            yield pa.RecordBatch.from_pylist([row(current, conversation)], schema)

    return run


def format_chats(events: DataFrame, learned_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Per conversation: ``conv``, ``n_turns``, ``formatted`` and ``loss``, the spans (from, to) that are learned.

    ``events`` has the columns ``EVENTS``. Kinds: *message* states a whole message, *delta* adds to one, *edit* replaces
    its text, *regenerate* does so and drops all messages after it, *remove* takes it out. A message keeps the place of
    its first event; a role that is given replaces the one before. Events without a message id are a message each. Null
    texts and roles are empty. Events are sorted by ``seq`` (null first), ties by message, kind, role and text; rows
    that repeat are applied again. Events without a conversation form one conversation, the null one. A conversation
    whose messages are all removed is formatted as the empty string. Other kinds are an error. Further columns are
    ignored.
    """
    rows = events.select(*(events[c.split()[0]].cast(c.split()[1]) for c in EVENTS.split(", ")))
    order = ["conv", "seq", "message", "kind", "role", "text"]
    schema = "conv long, n_turns long, formatted string, loss array<struct<`from`:int,`to`:int>>"
    return rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(_folded(frozenset(learned_roles)), schema)
