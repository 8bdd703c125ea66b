"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are context, and only
its text is trainable. Turns after the last assistant turn form a last record without a
trainable part, so that nothing of a conversation is lost.

A turn is written as ``[TURN:role]text[/TURN]``. Control strings inside roles and texts get a
backslash after their first sign, and backslashes are doubled, so the text can be read back.

Rows are sorted by conversation and turn and formatted as they stream by; a task holds one
conversation and a bounded batch of output.

Defined results. A null text or role is empty. Turns with the same number are ordered by role
and text, repeated rows are turns of their own. A null ``conv_id`` is a conversation of its
own, null turns come first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template, and strings of common templates that texts may hold.
OPEN, MIDDLE, CLOSE = "[TURN:", "]", "[/TURN]"
CONTROLS = (OPEN, CLOSE, "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TRAINED_ROLE = "assistant"
BATCH_CHARS = 4_000_000
EXAMPLES = "conv_id bigint, example int, text string, loss_start bigint, loss_end bigint"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"\[TURN:((?:\\.|[^\]\\])*)\](.*?)\[/TURN\]", re.DOTALL)


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text lies in it."""
    head = OPEN + escaped(role).replace("]", "\\]") + MIDDLE
    body = escaped(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def turns_in(text: str) -> list[tuple[str, str]]:
    """Read a formatted text back: role and text of every turn."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(text)]


def _ordered(conversations: DataFrame) -> DataFrame:
    plain = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _expand(batches):
    names = [f.split()[0] for f in EXAMPLES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    rows: list[tuple] = []
    size = 0

    def flush():
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    begun, current, parts, length, number, tail = False, None, [], 0, 0, False

    def rest():
        if begun and tail:
            rows.append((current, number, "".join(parts), length, length))

    for batch in batches:
        for conv, role, text in zip(*[batch.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
            if not begun or conv != current:
                rest()
                begun, current, parts, length, number, tail = True, conv, [], 0, 0, False
            turn, start, end = rendered(role, text)
            parts.append(turn)
            tail = role != TRAINED_ROLE
            if not tail:
                rows.append((conv, number, "".join(parts), length + start, length + end))
                number += 1
            length += len(turn)
            size += length if not tail else 0
            if size >= BATCH_CHARS:
                yield flush()
                rows.clear()
                size = 0
    rest()
    yield flush()


def examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: one row per assistant turn, then the rest.

    The records of a conversation follow each other in one partition, in order.
    """
    return _ordered(conversations).mapInArrow(_expand, EXAMPLES)


def _digest(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    begun, current, last, loss, trained, formatted, count = False, None, "", None, 0, 0, 0

    def row():
        turns = turns_in(last)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        return (current, len(turns), whole.hexdigest(), trained, loss.hexdigest(), formatted, count)

    for batch in batches:
        rows = []
        for conv, _, text, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not begun or conv != current:
                if begun:
                    rows.append(row())
                begun, current, loss, trained, formatted, count = True, conv, hashlib.sha256(), 0, 0, 0
            target = unescaped(text[start:end])
            loss.update(target.encode("utf-8", "surrogatepass"))
            trained += len(target)
            formatted += len(text)
            count += start < len(text)
            last = text
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """Read the records of ``examples`` back, conversation by conversation."""
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_examples bigint"
    )
    return formatted.mapInArrow(_digest, schema)
