"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, the reply as
the only text under the loss mask. Turns of a conversation are streamed in order, so a task holds
one conversation's prefix and one example at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import whole

OPEN, CLOSE = "<s>", "</s>"
#: Strings that must not reach a model from inside a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_control = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_escaped = re.compile(r"\\(.)", re.S)
_turn = re.compile(r"<s>((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)</s>", re.S)
_FLUSH_CHARS = 4 << 20


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character; double backslashes."""
    return _control.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of its text."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


_SCHEMA = "conv_id long, example long, formatted string, loss_start long, loss_end long"


def expand(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """The examples of all conversations, ordered within partitions.

    Returns conv_id, example long (from 0 within the conversation), formatted string, loss_start and
    loss_end long (code points; the span of the only trainable text). Turns after the last reply, or
    all of a conversation without replies, come as one last example with an empty span at its end.
    Turns are ordered by turn, role and text (nulls first); repeated turns stay. A null role or text
    is an empty one; rows without conv_id are one conversation. Other columns are ignored.
    """
    turns = conversations.select(whole(conversations, "conv_id", "long").alias("conv_id"), whole(conversations, "turn", "long").alias("turn"), F.coalesce(whole(conversations, "role", "string"), F.lit("")).alias("role"), F.coalesce(whole(conversations, "text", "string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            cols = list(zip(*rows, strict=True))
            rows.clear()
            size = 0
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "example", "formatted", "loss_start", "loss_end"])

        started, conv, n, parts, length, pending = False, None, 0, [], 0, False
        for batch in batches:
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not started or c != conv:
                    if pending:
                        rows.append((conv, n, "".join(parts), length, length))
                        size += length
                    started, conv, n, parts, length, pending = True, c, 0, [], 0, False
                turn, a, b = render_turn(role, text)
                parts.append(turn)
                pending = role != target_role
                if not pending:
                    if len(parts) > 64:
                        parts = ["".join(parts)]
                    rows.append((conv, n, "".join(parts), length + a, length + b))
                    n += 1
                    size += length
                length += len(turn)
                if size > _FLUSH_CHARS:
                    yield flush()
        if pending:
            rows.append((conv, n, "".join(parts), length, length))
        if rows:
            yield flush()

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _SCHEMA)


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of ``expand`` hold, read back from their formatted strings: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars and n_examples of each conversation.
    Examples must come as ``expand`` leaves them, in order within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state: list | None = None  # conv, last formatted, loss chars, loss hash, chars, examples

        def done(s: list) -> tuple:
            turns = parse(s[1])
            h = hashlib.sha256()
            for role, text in turns:
                h.update(f"{role}\n{text}\n".encode())
            return s[0], len(turns), h.hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]

        for batch in batches:
            out = []
            for conv, _, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done(state))
                    state = [conv, "", 0, hashlib.sha256(), 0, 0]
                loss = unescape(formatted[a:b])
                state[1] = formatted
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
                state[5] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(state), kinds, strict=True)], names=names)

    return examples.select("conv_id", "example", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
