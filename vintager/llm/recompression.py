"""Substring deduplication by recompression.

Every word is named by a hash of its bytes. A round names each maximal run of one symbol by (symbol,
length) and then each adjacent pair whose symbols fall on the two sides of a split of all symbols,
by (left, right). Names are hashes of what they stand for, so all tasks agree on them globally and
equal substrings get equal symbols except near their ends. With each symbol goes the range of words
that its name depends on; within a window, the symbols whose range lies inside are the ones that any
equal window has too. The smallest of them is the window's anchor (a window without one, as inside a
long run, falls back to its smallest word), and shared anchors, named with the
words they depend on, reveal the repeats, which ``repeats`` verifies down to whole windows.

Two rounds suit a window of 20 words: a symbol then stands for 1.8 words and depends on about ten.

Removed are the words covered by a window whose words also start earlier; windows are judged on the
input. Defined cases: a null or empty text has no words; a text shorter than the window keeps all;
repeated rows of one document are one document and count once; a null doc_id comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vintager.llm import repeats
from vintager.llm.common import Ranges, mix, slices, utf8, words

WINDOW = 20
ROUNDS = 2
_RUN, _PAIR, _WORD = np.uint64(0x8F14E45FCEEA167A), np.uint64(0xA87FF679A2F3E71D), np.uint64(97)


def compress(
    names: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first word, dependency start, dependency end) after the rounds.

    ``row`` tells the document of each word, ``first`` and ``last`` where its document starts and
    ends; what depends on an end of a document depends on a word outside it.
    """
    at = np.arange(len(names))
    low, high = at.copy(), at + 1
    outside_low, outside_high = first - 1, last + 1
    for turn in range(rounds):
        # Runs: a symbol is known to end where its neighbours differ, so it depends on them.
        equal = (names[1:] == names[:-1]) & (row[1:] == row[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~equal)))
        tail = np.append(head[1:], len(names)) - 1
        length = tail - head + 1
        named = mix(mix(names[head] ^ _RUN) + length.astype(np.uint64))
        before, after = head - 1, np.minimum(tail + 1, len(names) - 1)
        joined_before = (head > 0) & (row[before] == row[head])
        joined_after = (tail + 1 < len(names)) & (row[after] == row[head])
        new_low = np.where(
            joined_before, np.minimum(low[head], low[before]), outside_low[head]
        )
        new_high = np.where(
            joined_after, np.maximum(high[tail], high[after]), outside_high[head]
        )
        names = np.where(length > 1, named, names[head])
        at, row, low, high = at[head], row[head], new_low, new_high
        outside_low, outside_high = outside_low[head], outside_high[head]
        # Pairs: the left half of the symbols meets the right half.
        right = (mix(names + np.uint64((turn + 1) * int(_PAIR) % 2**64)) >> np.uint64(63)).astype(bool)
        n = len(names)
        same = np.zeros(n + 1, bool)
        same[1:n] = row[1:] == row[:-1]
        follows, precedes = same[1:], same[:-1]
        nxt, prv = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        opens = ~right & follows & right[nxt]
        closes = right & precedes & ~right[prv]
        paired = mix(mix(names ^ _PAIR) + names[nxt])
        new_low = np.where(
            right & ~closes,
            np.where(precedes, np.minimum(low, low[prv]), outside_low),
            low,
        )
        new_high = np.where(
            ~right, np.where(follows, np.maximum(high, high[nxt]), outside_high), high
        )
        new_low = np.where(
            ~right & follows, np.minimum(new_low, low[nxt]), new_low
        )
        new_high = np.where(
            right & ~closes & precedes, np.maximum(new_high, high[prv]), new_high
        )
        keep = ~closes
        names = np.where(opens, paired, names)[keep]
        at, row, low, high = at[keep], row[keep], new_low[keep], new_high[keep]
        outside_low, outside_high = outside_low[keep], outside_high[keep]
    return names, at, low, high


def anchors(
    names: np.ndarray, rows: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, core, anchor word) of every window that lies in one document."""
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts)), counts)
    last = rows[1:][row]
    starts = np.flatnonzero(np.arange(len(names)) + window <= last)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), starts
    symbol, at, low, high = compress(names, row, rows[:-1][row], last, rounds)
    # A symbol serves the windows [high - window, low]; the smallest name is written last and stays.
    order = np.argsort(symbol, kind="stable")[::-1]
    order = order[low[order] - (high[order] - window) >= 0]
    n = low[order] - (high[order] - window) + 1
    run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    where = np.repeat(high[order] - window, n) + run
    inside = where >= 0
    best = np.full(len(names), -1)
    best[where[inside]] = np.repeat(order, n)[inside]
    chosen = best[starts]
    # All words that the symbol depends on are in every such window, so they go into its name.
    near, far = np.maximum(low[chosen], 0), np.minimum(high[chosen], len(names))
    core = mix(symbol[chosen] ^ Ranges(names).names(near, far))
    anchor = np.where(chosen >= 0, at[chosen], 0)
    bare = np.flatnonzero(chosen < 0)
    for piece in np.array_split(bare, len(bare) // 50_000 + 1):
        if len(piece):
            view = np.lib.stride_tricks.sliding_window_view(names, window)[starts[piece]]
            anchor[piece] = starts[piece] + view.argmin(axis=1)
            core[piece] = mix(names[anchor[piece]] ^ _WORD)
    return starts, core, anchor


def emit_units(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, ver in repeats.rows_of(batches):
            names, rows = words(*utf8(batch.column("text")))
            starts, core, anchor = anchors(names, rows, window, rounds)
            if not len(starts):
                continue
            change = (np.diff(starts) != 1) | (core[1:] != core[:-1]) | (anchor[1:] != anchor[:-1])
            head = np.flatnonzero(np.concatenate(([True], change)))
            n = np.diff(np.append(head, len(starts)))
            begin, distance = starts[head], anchor[head] - starts[head]
            hull = Ranges(names).names(begin, begin + n - 1 + window)
            hull = mix(hull ^ distance.astype(np.uint64))
            owner = np.searchsorted(rows, begin, "right") - 1
            pos = repeats.pack(begin - rows[owner], n, distance)
            yield repeats.unit_batch(core[head], hull, doc[owner], ver[owner], pos)

    return run


def emit_windows(window: int):
    """Every window of the units to split, under two independent names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, doc, ver in repeats.rows_of(batches):
            names, rows = words(*utf8(batch.column("text")))
            ranges, second = Ranges(names), Ranges(mix(names ^ _WORD))
            lists = batch.column("items")
            owner = np.repeat(np.arange(len(doc)), np.diff(lists.offsets.to_numpy()))
            start, n, _ = repeats.unpack(lists.flatten().to_numpy())
            begin = start + rows[owner]
            unit = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
            one = begin[unit] + step
            core, hull = ranges.names(one, one + window), second.names(one, one + window)
            who = owner[unit]
            one_each, at_once = np.ones(len(unit), np.int64), np.zeros(len(unit), np.int64)
            pos = repeats.pack(start[unit] + step, one_each, at_once)
            yield repeats.unit_batch(core, hull, doc[who], ver[who], pos)

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) per row of ``docs``."""
    spans = repeats.repeated_spans(
        docs, window, emit_units(window, rounds), emit_windows(window), keep_first=True
    )
    joined = repeats.with_lists(docs.select("doc_id", "text"), spans, "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n_words, n_removed, kept_text, digest = [], [], [], []
            for text, items in zip(texts, batch.column("items").to_pylist(), strict=True):
                found = (text or b"").split()  # the same six separators
                n_words.append(len(found))
                left, at = [], 0
                for start, end in repeats.merged(items or []):
                    left += found[at:start]
                    at = end
                left += found[at:]
                n_removed.append(len(found) - len(left))
                kept = b" ".join(left)
                kept_text.append(kept)
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept_text, pa.binary()).cast(pa.string()), pa.array(digest),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "items").mapInArrow(
        apply,
        f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string",
    )
