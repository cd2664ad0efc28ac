"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn, each turn between the marks of its role:

    system     [SYS] text [/SYS]
    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  [ROLE] role [/ROLE] text </s>

(no blanks). Inside a text a mark may also stand escaped, with backslashes after its first character; reading takes one of them
off. A turn is rendered as it is, read back by the parser and compared; only if it isn't recovered is its content
escaped (one more backslash in each mark or escaped mark), which always reads back. The loss mask covers the content
and the end mark of assistant turns.

Rows of a conversation are read in order from sorted partitions, one turn at a time, so a conversation of any length takes
little memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "</s>")
_TAIL = r"(/?(?:SYS\]|INST\]|ROLE\])|/?s>)"
_MARK = re.compile(r"\[/?(?:SYS|INST|ROLE)\]|</?s>")
_ESCAPABLE = re.compile(rf"([\[<])(\\*){_TAIL}")
_ESCAPED = re.compile(rf"([\[<])\\(\\*){_TAIL}")
_ROLES = {opening: (role, closing) for role, (opening, closing) in MARKS.items()}


def escape(content: str) -> str:
    return _ESCAPABLE.sub(r"\1\\\2\3", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", content)


def parse(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn at position ``at``: role, content as it was, start and end of the rendered content, end of the turn."""

    def mark(position: int) -> re.Match:
        found = _MARK.search(text, position)
        if found is None:
            raise ValueError("a mark is missing")
        return found

    opening = mark(at)
    if opening.start() != at:
        raise ValueError("text outside a turn")
    start = opening.end()
    if opening[0] == OTHER[0]:
        middle = mark(start)
        if middle[0] != OTHER[1]:
            raise ValueError("a role's mark is left open")
        role, closing_mark, start = unescape(text[start : middle.start()]), OTHER[2], middle.end()
    elif opening[0] in _ROLES:
        role, closing_mark = _ROLES[opening[0]]
    else:
        raise ValueError("a turn begins with an end mark")
    closing = mark(start)
    if closing[0] != closing_mark:
        raise ValueError("another mark inside a turn")
    return role, unescape(text[start : closing.start()]), start, closing.start(), closing.end()


def render(role: str, content: str) -> tuple[str, int, int]:
    """The rendered turn and where in it the rendered content starts and ends; it always reads back as (role, content)."""
    for change in (lambda x: x, escape):
        if role in MARKS:
            opening, closing = MARKS[role]
        else:
            opening, closing = f"{OTHER[0]}{change(role)}{OTHER[1]}", OTHER[2]
        text = f"{opening}{change(content)}{closing}"
        try:
            got = parse(text)
        except ValueError:
            continue
        if got[:2] == (role, content) and got[4] == len(text):
            return text, got[2], got[3]
    raise AssertionError("an escaped turn reads back")


_SEGMENTS = "conv_id long, segment long, rendered string, start long, loss_start long, loss_end long, last boolean"
_NAMES = [x.split()[0] for x in _SEGMENTS.split(", ")]


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered segments of the conversations in ``turns`` (conv_id, turn, role, text), one per turn, in order within a partition.

    A conversation's text is its segments one after another; ``start`` is a segment's place in it, [loss_start, loss_end) the
    places under the loss mask (NULL outside assistant turns), in code points; ``last`` ends a conversation. Order: turn (NULL first),
    role, text; NULL roles and texts count as empty; a NULL conv_id is a conversation of its own; repeated rows are repeated
    turns; an empty table gives an empty table; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the segment that is known not to be, or to be, the last only at the next row
        key, number, place = object(), 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for conv, role, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    rows.append((*held, conv != key))
                if held is None or conv != key:
                    key, number, place = conv, 0, 0
                text, low, high = render(role, content)
                masked = (place + low, place + high) if role == "assistant" else (None, None)
                held = (conv, number, text, place, *masked)
                number, place = number + 1, place + len(text)
            yield _batch(rows)
        if held is not None:
            yield _batch([(*held, True)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(scan, _SEGMENTS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def in_order(segments: DataFrame) -> DataFrame:
    """Stored segments, read again, in the order that format_chats gives them."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, read from the rendered segments of format_chats by the parser. Segments out of order are an error.

    ``n_turns``; ``turns_sha256`` (of role, newline, text, newline per turn); ``loss_chars`` and ``loss_sha256`` of all text under the
    loss mask, unescaped; ``formatted_chars``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        key, expected, done = None, 0, True
        for batch in batches:
            rows: list[tuple] = []
            for conv, number, text, start, low, high, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != expected or not done and conv != key or start != total:
                    raise ValueError("segments are out of order: in_order arranges them")
                key, expected, done, at = conv, 0 if last else expected + 1, last, 0
                while at < len(text):
                    role, content, _, _, at = parse(text, at)
                    turns.update(f"{role}\n{content}\n".encode())
                    n += 1
                if low is not None:
                    masked = unescape(text[low - start : high - start])
                    loss.update(masked.encode())
                    chars += len(masked)
                total += len(text)
                if last:
                    rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])

    return segments.mapInArrow(scan, _READ)
