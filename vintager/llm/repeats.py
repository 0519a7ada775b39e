"""Repeated windows of fixed length over all documents, without a row per window.

Both repeat operators name every window by an anchor: a place inside the window that its content
alone chooses, so equal windows have equal anchors at equal distances. Consecutive windows with one
anchor form a unit (core: the anchor's name; hull: the name of all text under the unit). Then

1. units whose core occurs once are dropped: none of their windows can repeat;
2. units with equal hulls hold the same windows, so one of them stands for all;
3. only where one core has several hulls do windows differ. Those few units are split into smaller
   units with longer cores, and ranked again, down to single windows of full length.

The hull is a 64-bit name compared only among units of one 64-bit core name, so a wrong match needs
both to collide. A hot passage is one group that is reduced before the shuffle; marks are joined
back by a sort-merge join whose hot keys adaptive execution splits.

A place is (doc_id, start). Rows that share a doc_id are versions of one document: the same start in
two of them is one place, and each version is judged on its own text. Where there are such rows, a
hull's first and last place stand for it, as one place may have several hulls, and both are split in
all versions that have them. A null doc_id is ordered first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import doc_key, slices, text_version, written

# start << 20 | windows << 10 | distance of the first window's anchor
N_BITS = 10
# Spans or units that may be sent to all executors (about 24 bytes each); more go by a shuffle.
BROADCAST_ITEMS = 1_000_000

UNIT = "core long, hull long, doc long, ver long, pos long, names binary"
Emit = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def pack(start: np.ndarray, n: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 2 * N_BITS) | (n.astype(np.int64) << N_BITS) | distance


def unpack(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << N_BITS) - 1
    return pos >> 2 * N_BITS, (pos >> N_BITS) & low, pos & low


def unit_batch(core, hull, doc, ver, pos, names=None) -> pa.RecordBatch:
    """Rows of ``UNIT``; names are the single windows of a small unit, eight bytes each."""
    n = len(core)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(core.view(np.int64)),
            pa.array(hull.view(np.int64)),
            pa.array(np.asarray(doc, np.int64)),
            pa.array(np.asarray(ver, np.int64)),
            pa.array(pos),
            pa.nulls(n, pa.binary()) if names is None else pa.array(names, pa.binary()),
        ],
        ["core", "hull", "doc", "ver", "pos", "names"],
    )


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("doc"), text_version().alias("ver"), "text")


class Ranking:
    """One round: which units repeat, and which of a core's hulls must be split."""

    def __init__(self, units: DataFrame, keep_first: bool, versions: bool):
        place = F.struct("doc", "pos", "ver")
        groups = written(
            units.groupBy("core", "hull").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        )
        start = lambda x: F.struct(
            F.col(f"{x}.doc"), F.shiftright(F.col(f"{x}.pos"), 2 * N_BITS)
        )
        repeated = groups.filter(start("first") != start("last")).select(
            F.col("core").alias("c"), F.col("hull").alias("h"),
            F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"),
        )
        found = units.join(repeated, (F.col("core") == F.col("c")) & (F.col("hull") == F.col("h")))
        if keep_first:
            found = found.filter(
                (F.col("doc") != F.col("first_doc"))
                | (F.shiftright("pos", 2 * N_BITS) != F.shiftright("first_pos", 2 * N_BITS))
            )
        self.marked = found.select("doc", "ver", "pos")
        split = groups.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core")
        stands = F.explode(F.array("first", "last")) if versions else F.col("first")
        self.split = groups.join(split, "core").select("core", "hull", stands.alias("p")).select(
            "core", "hull", F.col("p.doc").alias("doc"), F.col("p.ver").alias("ver"),
            F.col("p.pos").alias("pos"),
        )


def _in_all_versions(places: DataFrame, units: DataFrame, several: DataFrame) -> DataFrame:
    """``places`` and the same units in other rows of the documents that have ``several``."""
    unit = ["core", "hull", "doc", "pos"]
    others = units.join(several, "doc", "left_semi").join(places.select(unit), unit, "left_semi")
    return places.unionByName(others).distinct()


def _checked(df: DataFrame, items: str) -> DataFrame:
    """Broadcast ``df`` if the sum of ``items`` proves it small; else AQE joins by a shuffle."""
    total = df.agg(F.sum(F.expr(items))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_ITEMS else df


def with_lists(docs: DataFrame, items: DataFrame, how: str) -> DataFrame:
    """``docs`` with the ``items`` (doc, ver, item) of each row as a list; bounded by the text."""
    lists = written(items.groupBy("doc", "ver").agg(F.collect_list("item").alias("items")))
    side = _checked(lists, "size(items)").withColumnsRenamed({"doc": "__doc", "ver": "__ver"})
    on = (doc_key() == F.col("__doc")) & (text_version() == F.col("__ver"))
    return docs.join(side, on, how)


def repeated_spans(
    docs: DataFrame, width: int, units: Emit, smaller: Emit, keep_first: bool
) -> DataFrame:
    """(doc, ver, item): spans, as start << 32 | end, covered by windows that repeat.

    With ``keep_first`` a window counts only where an equal one starts earlier. ``units`` reads
    (doc, ver, text); ``smaller`` reads the units to split as well and cuts them, naming the single
    windows of each part.
    """
    docs = docs.select("doc_id", "text")
    rows = keyed(docs).mapInArrow(units, UNIT).drop("names")
    shared = written(rows.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"))
    kept = written(rows.join(shared, "core", "left_semi"))
    several = written(
        docs.groupBy(doc_key().alias("doc")).agg(F.count("*").alias("n")).filter("n > 1").select("doc")
    )
    versions = not several.isEmpty()
    first = Ranking(kept, keep_first, versions)
    places = _in_all_versions(first.split, kept, several) if versions else first.split
    split = with_lists(
        docs, places.select("doc", "ver", F.col("pos").alias("item")), "inner"
    ).select(F.col("__doc").alias("doc"), F.col("__ver").alias("ver"), "text", "items")
    parts = written(split.mapInArrow(smaller, UNIT))
    second = Ranking(parts.drop("names"), keep_first, versions)
    chosen = second.split.select(
        F.col("core").alias("c"), F.col("hull").alias("h"), F.col("doc").alias("dd"),
        F.col("pos").alias("pp"),
    )
    open_parts = parts.join(
        chosen,
        (F.col("core") == F.col("c")) & (F.col("hull") == F.col("h"))
        & (F.col("doc") == F.col("dd")) & (F.col("pos") == F.col("pp")),
        "left_semi",
    )
    single = written(
        open_parts.select("core", "doc", "ver", "pos", F.expr(
            "posexplode(transform(sequence(0, cast(length(names) / 8 as int) - 1),"
            " i -> conv(hex(substring(names, i * 8 + 1, 8)), 16, -10)))"
        ).alias("i", "name"))
        .select(
            "core", F.col("name").cast("long").alias("hull"), "doc", "ver",
            F.shiftleft(F.shiftright("pos", 2 * N_BITS) + F.col("i"), 2 * N_BITS).bitwiseOR(
                F.lit(1 << N_BITS).cast("long")
            ).alias("pos"),
        )
    )
    third = Ranking(single, keep_first, versions)
    marked = first.marked.union(second.marked).union(third.marked)
    start = F.shiftright("pos", 2 * N_BITS)
    windows = F.shiftright("pos", N_BITS).bitwiseAND(F.lit((1 << N_BITS) - 1))
    return marked.select(
        "doc", "ver",
        F.shiftleft(start, 32).bitwiseOR(start + windows - 1 + width).alias("item"),
    )


def merged(items: list[int]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, from packed ones."""
    out: list[tuple[int, int]] = []
    for item in sorted(items):
        start, end = item >> 32, item & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row batch, doc list, ver list) of a few megabytes each."""
    for batch in slices(batches):
        yield batch, batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
