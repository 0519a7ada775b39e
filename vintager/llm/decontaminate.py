"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and reduced to words joined by single blanks. An item of m
characters may differ by k = m // ``CHARS_PER_ERROR`` edits. Cut into k + 1 pieces, one of them
must occur exactly in any passage within k edits, so one Aho-Corasick pass finds all candidates;
each is verified with Myers' bit-parallel distance over the item's surroundings.

The items are sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each block matched
against all documents; a larger benchmark takes more passes, never fewer items.

An item shorter than ``SHORT_CHARS`` after normalisation has too little in it to allow errors: it is
searched as it is, from word boundary to word boundary.

Defined cases: null or empty texts contain nothing, null or blank items occur nowhere; a text of any
length is searched whole; repeated rows and repeated items each give their own matches; empty tables
give none; other columns, whatever their names, are kept by ``clean`` and left out by ``matches``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import slices

CHARS_PER_ERROR = 16
SHORT_CHARS = 32
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the best match of ``pattern`` anywhere in ``text``, the first of equals."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, best_end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        d0 = ((((eq & pv) + pv) ^ pv) | eq | mv) & full
        ph = mv | (full & ~(d0 | pv))
        mh = pv & d0
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # The text before a match is free, so nothing is shifted in at the bottom.
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(d0 | ph))
        mv = ph & d0
        if score < best:
            best, best_end = score, j
    return best, best_end


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, text) of errors + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def allowed(item: str) -> int:
    """The edits by which an occurrence of a normalised item may differ from it."""
    return 0 if len(item) < SHORT_CHARS else len(item) // CHARS_PER_ERROR


class Matcher:
    """Finds the items of a block in a normalised text."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        where: dict[str, list[tuple[int, int]]] = {}
        self.budgets = [allowed(text) for _, text in items]
        for i, (_, text) in enumerate(items):
            # A short item takes the blanks around it along.
            short = len(text) < SHORT_CHARS
            for offset, piece in [(-1, f" {text} ")] if short else pieces(text, self.budgets[i]):
                where.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def __call__(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item, distance, budget, start, end): the best match of each item that occurs."""
        if self.empty:
            return
        at: dict[int, set[int]] = {}
        # The blank put before the text moves every place by one.
        for end, (length, found) in self.automaton.iter(f" {text} "):
            for i, offset in found:
                at.setdefault(i, set()).add(end - length - offset)
        for i, starts in at.items():
            item_id, item = self.items[i]
            budget, reach, best = self.budgets[i], -1, None
            spans: list[list[int]] = []
            for start in sorted(starts):
                low, high = max(0, start - budget), start + len(item) + budget
                if spans and start <= reach:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
                reach = start + budget
            for low, high in spans:
                distance, end = myers(item, text[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    from_end = text[low : low + end][::-1]
                    _, back = myers(item[::-1], from_end[: len(item) + budget])
                    best = distance, low + end - back, low + end
                if best and best[0] == 0:
                    break
            if best:
                yield item_id, best[0], budget, best[1], best[2]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    size = F.length("text")
    items = benchmark.filter("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(size)).first()[0] or 0
    n = int(total // BLOCK_CHARS) + 1
    for i in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = [(r[0], normal(r[1])) for r in block.collect()]
        yield [r for r in rows if r[1]]


def _finder(items: list[tuple[int, str]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in slices(batches):
            out: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                out += ((doc_id, *found) for found in matcher(normal(text)))
            names = ["doc_id", "item_id", "distance", "budget", "match_start", "match_end"]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, budget, match_start, match_end) of every item found in a text.

    The place is given in the normalised text.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in _blocks(benchmark):
        part = slim.mapInArrow(
            _finder(items),
            "doc_id long, item_id long, distance long, budget long, match_start long, match_end long",
        )
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged."""
    schema = docs.schema
    for items in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for batch in slices(batches):
                texts = batch.column("text").to_pylist()
                free = [next(matcher(normal(text)), None) is None for text in texts]
                yield batch.filter(pa.array(free, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
