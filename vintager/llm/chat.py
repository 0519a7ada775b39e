r"""Chat formatting by columnar byte assembly.

A turn is written as ``<turn ROLE>\nTEXT</turn>\n``. Inside roles and texts a backslash becomes
``\\``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``, so no text can imitate a mark, and reading
back reverses it. All turns of a batch are assembled at once: numpy computes segment lengths,
cumulative offsets and the scatter index of every byte, and headers and contents are copied into one
preallocated buffer, which becomes the Arrow column. The loss mask lists the byte spans of the
assistant's texts.

Turns are ordered by (turn, role, text), a null turn first. Defined cases: a null text or role is
empty; a conversation of empty texts still has its marks; repeated rows are turns of their own; rows
without conv_id form one conversation; an empty table gives no rows; other columns are left out.
A conversation is one output value, so it has to fit into a task; it is never grouped in the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import utf8

LEARNED_ROLE = "assistant"
FOOTER = b"</turn>\n"
_OPEN, _CLOSE = b"<turn ", b">\n"
_ESCAPES = {ord("\\"): ord("\\"), ord("<"): ord("l"), ord(">"): ord("g")}
_CODE = np.zeros(256, np.uint8)
for _byte, _code in _ESCAPES.items():
    _CODE[_byte] = _code
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,end:long>>"
# Turns are collected up to so many bytes before they are assembled.
BATCH_BYTES = 4 << 20


def _scatter(out: np.ndarray, data: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> None:
    """Copy consecutive segments of ``data`` to ``starts`` in ``out``."""
    before = np.cumsum(lengths) - lengths
    index = np.arange(len(data)) + np.repeat(starts - before, lengths)
    out[index] = data


def _escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes and their offsets."""
    special = _CODE[data] != 0
    extra = np.zeros(len(data) + 1, np.int64)
    np.cumsum(special, out=extra[1:])
    out = np.empty(len(data) + int(extra[-1]), np.uint8)
    place = np.arange(len(data)) + extra[1:]
    out[place] = np.where(special, _CODE[data], data)
    out[place[special] - 1] = ord("\\")
    return out, offsets + extra[offsets]


def assemble(turns: pa.RecordBatch) -> pa.RecordBatch:
    """One row per conversation of ``turns`` (conv_id, role, text), which are in order."""
    content, c_off = _escaped(*utf8(turns.column("text")))
    role, r_off = _escaped(*utf8(turns.column("role")))
    n = turns.num_rows
    c_len, r_len = np.diff(c_off), np.diff(r_off)
    head = len(_OPEN) + r_len + len(_CLOSE)
    total = head + c_len + len(FOOTER)
    ends = np.cumsum(total)
    at = ends - total
    out = np.empty(int(ends[-1]), np.uint8)

    def constant(raw: bytes, starts: np.ndarray) -> None:
        _scatter(out, np.tile(np.frombuffer(raw, np.uint8), n), np.full(n, len(raw)), starts)

    constant(_OPEN, at)
    _scatter(out, role, r_len, at + len(_OPEN))
    constant(_CLOSE, at + len(_OPEN) + r_len)
    _scatter(out, content, c_len, at + head)
    constant(FOOTER, ends - len(FOOTER))

    conv = turns.column("conv_id")
    ids = pc.fill_null(conv, -(2**63)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    bounds = np.append(at[first], ends[-1])
    text = pa.Array.from_buffers(
        pa.large_string(), len(first),
        [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out)],
    )
    learned = pc.fill_null(pc.equal(turns.column("role"), LEARNED_ROLE), False)
    learned = np.flatnonzero(learned.to_numpy(zero_copy_only=False))
    owner = np.searchsorted(first, learned, "right") - 1
    start = (at + head)[learned] - bounds[owner]
    spans = pa.StructArray.from_arrays(
        [pa.array(start), pa.array(start + c_len[learned])], ["start", "end"]
    )
    counts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(first)))))
    loss = pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), text.cast(pa.string()), loss],
        ["conv_id", "formatted", "loss"],
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted turns in batches that end where a conversation ends."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) < BATCH_BYTES:
            continue
        table = joined()
        ids = pc.fill_null(table.column("conv_id"), -(2**63)).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held[:] = [table.slice(cut)]
    if held:
        yield joined()


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) per conversation; loss spans are in bytes of formatted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _conversations(batches):
            yield assemble(part)

    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


_TURN = re.compile(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n")
_BACK = {"\\\\": "\\", "\\l": "<", "\\g": ">"}


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\[\\lg]", lambda m: _BACK[m[0]], text)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for found in _TURN.finditer(text):
        if found.start() != at:
            raise ValueError(f"No turn at {at}.")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    if at != len(text):
        raise ValueError(f"No turn at {at}.")
    return turns


def read_back(rows: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted text and the loss mask alone."""
    names = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = row["formatted"].encode()
                turns = parse(row["formatted"])
                body = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescaped(raw[s["start"] : s["end"]].decode()) for s in row["loss"])
                digests = (hashlib.sha256(x.encode()).hexdigest() for x in (body, loss))
                out.append(
                    (row["conv_id"], len(turns), next(digests), len(loss), next(digests),
                     len(row["formatted"]))
                )
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                [x.split()[0] for x in names.split(", ")],
            )

    return rows.mapInArrow(run, names)
