"""Removal of byte strings that occur more than once, by distributed prefix doubling.

Prefix doubling ranks positions by a short prefix, then by pairs of ranks at growing offsets, and
drops a position once its rank is unique or its prefix has reached the threshold. A row per byte and
round would be several hundred times the text, so positions are ranked in bundles: a window of
``LENGTH`` bytes belongs to the position of its smallest ``ANCHOR``-byte block, which equal windows
share, and the windows of one position form a unit. The rounds are

1. rank of the 200-byte block at each position; unique ones are dropped;
2. pair (block, all bytes under the unit): equal pairs are past the threshold for every window, and
   one position goes on for all of them;
3. where a block still has several continuations, cells of 16 neighbouring windows: pair (the 385
   bytes that all windows of the cell have, the cell's bytes);
4. where those still differ, single windows: pair (385 bytes, all 400).

Spark groups and ranks each round; see ``repeats``.

Removed is each byte covered by a 400-byte string that also starts elsewhere; strings are judged on
the input. Defined cases: a null or empty text has no bytes; a text shorter than 400 bytes stays
whole; repeated rows of one document are one document and don't repeat each other; what is left is
given as bytes, as a span may cut a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vintager.llm import repeats
from vintager.llm.common import BYTE_HASH, SLICE_BYTES, Ranges, mix, slices, utf8

LENGTH = 400
ANCHOR = 200
CELL = 16
_POS_BITS = 22


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def _segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple]:
    """(bytes, offsets, first row, shift): rows as they are, or overlapping parts of a long one."""
    if len(data) <= 2 * SLICE_BYTES:
        yield data, offsets, 0, 0
        return
    for row in range(len(offsets) - 1):
        text = data[offsets[row] : offsets[row + 1]]
        for at in range(0, max(1, len(text) - length + 1), SLICE_BYTES):
            part = text[at : at + SLICE_BYTES + length - 1]
            yield part, np.array([0, len(part)]), row, at


def emit_units(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, ver in repeats.rows_of(batches):
            data, offsets = utf8(batch.column("text"))
            for part, offs, row, shift in _segments(data, offsets, length):
                if len(part) < length:
                    continue
                ranges = Ranges(BYTE_HASH[part])
                at = np.arange(len(part) - anchor + 1)
                blocks = ranges.names(at, at + anchor)
                low = np.uint64((1 << _POS_BITS) - 1)
                keys = (blocks & ~low) | at.astype(np.uint64)
                best = (smallest(keys, length - anchor + 1) & low).astype(np.int64)
                # Windows that lie in one row; their starts by unit.
                owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                ends = offs[1:][owner[: len(best)]]
                starts = np.flatnonzero(np.arange(len(best)) + length <= ends)
                if not len(starts):
                    continue
                place = best[starts]
                change = (np.diff(starts) != 1) | (place[1:] != place[:-1])
                head = np.flatnonzero(np.concatenate(([True], change)))
                n = np.diff(np.append(head, len(starts)))
                begin, place = starts[head], place[head]
                distance = place - begin
                hull = ranges.names(begin, begin + n - 1 + length)
                hull = mix(hull ^ distance.astype(np.uint64))
                who = owner[begin]
                pos = repeats.pack(begin - offs[who] + shift, n, distance)
                yield repeats.unit_batch(mix(blocks[place]), hull, doc[who + row], ver[who + row], pos)

    return run


def emit_cells(length: int, cell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, ver in repeats.rows_of(batches):
            data, offsets = utf8(batch.column("text"))
            ranges, lists = Ranges(BYTE_HASH[data]), batch.column("items")
            owner = np.repeat(np.arange(len(doc)), np.diff(lists.offsets.to_numpy()))
            start, n, distance = repeats.unpack(lists.flatten().to_numpy())
            begin = start + offsets[owner]
            anchor = begin + distance
            # A cell holds the windows at distances cell * t .. cell * t + cell - 1.
            high, lowest = distance // cell, (distance - n + 1) // cell
            cells = high - lowest + 1
            unit = np.repeat(np.arange(len(n)), cells)
            t = high[unit] - (np.arange(len(unit)) - np.repeat(np.cumsum(cells) - cells, cells))
            far = np.minimum(distance[unit], cell * t + cell - 1)
            near = np.maximum((distance - n + 1)[unit], cell * t)
            from_, to = anchor[unit] - far, anchor[unit] - near
            core_at = anchor[unit] - cell * t
            core = ranges.names(core_at, core_at - cell + 1 + length)
            core = mix(core ^ (cell * t).astype(np.uint64))
            hull = mix(ranges.names(from_, to + length) ^ mix((far * 4096 + near).astype(np.uint64)))
            size = to - from_ + 1
            each = np.repeat(from_, size) + np.arange(int(size.sum())) - np.repeat(
                np.cumsum(size) - size, size
            )
            single = ranges.names(each, each + length).byteswap().tobytes()
            bounds = np.concatenate(([0], np.cumsum(size) * 8)).astype(np.int32)
            names = pa.Array.from_buffers(
                pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(single)]
            )
            who = owner[unit]
            pos = repeats.pack(from_ - offsets[who], size, np.zeros(len(size), np.int64))
            yield repeats.unit_batch(core, hull, doc[who], ver[who], pos, names)

    return run


def deduplicated(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, cell: int = CELL
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) per row of ``docs``."""
    spans = repeats.repeated_spans(
        docs, length, emit_units(length, anchor), emit_cells(length, cell), keep_first=False
    )
    joined = repeats.with_lists(docs.select("doc_id", "text"), spans, "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for text, items in zip(texts, batch.column("items").to_pylist(), strict=True):
                text, found = text or b"", repeats.merged(items or [])
                left, at = [], 0
                for start, end in found:
                    left.append(text[at:start])
                    at = end
                kept = b"".join([*left, text[at:]])
                row = len(text), len(text) - len(kept), len(found), kept
                for column, value in zip(out, (*row, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, out, kinds)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "items").mapInArrow(
        apply,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary,"
        " kept_sha256 string",
    )
