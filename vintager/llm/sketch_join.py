"""Similarity join on word shingles by parity sketches.

A document's distinct shingles are hashed to the bits of a sketch, each toggling one bit. Two
sketches differ in at most as many bits as the sets have shingles apart. A similarity of at least
t/100 leaves sets of sizes a <= b at most (a+b)(100-t)/(100+t) apart, so a sketch cut into one block
more than that has an equal block in every linked pair. Sizes fall into bands, which fix the number
of blocks; a document near the top of its band also joins the next one.

Equal sets are one class, named by a hash of the set; only classes are joined. A block is kept as
the exclusive or of one random value per set bit, which cancels as the bits do. One shuffle sorts
the blocks, and a pass over the sorted rows keeps those that several classes share; blocks shared by
the same classes count once. Within such a group the classes' short sketches, of at least four bits
a shingle, are compared in numpy. A group of more than ``CELL`` classes is dealt to cells that hold
two of its parts each, so that no task holds a large group. Of the pairs whose sketches are near
enough a cell passes on a spanning forest; whole sets verify it. A second round passes on every near
pair that these links left apart. So pairs are never all emitted, and no link between components is
lost.

Shingles and sets are compared by 64-bit hashes. Defined cases: null, empty and blank texts have no
shingles and link with nothing; a text of fewer words than a shingle is one shingle; repeated rows
are linked as equal texts; a null doc_id is a document of its own id, ordered first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.llm.common import (
    NULL_ID, components, doc_key, mix, slices, stored, text_version, utf8, words,
)
from vintager.operators.sizing import broadcast_if_small

SHINGLE = 3
PERCENT = 90
# Bits of a sketch per block. Sketches are never laid out, so blocks may be wide: a block with one
# bit set then equals another only if both have that shingle.
BLOCK_BITS = 1 << 32
BAND_RATIO = 1.25
# Most classes of a part of a group; a task compares two parts at a time.
CELL = 1024
# Classes that a task remembers to have cut into blocks; further copies of them add no rows.
REMEMBERED = 200_000
# Longest short sketch; sets of more than a quarter as many shingles are told apart less well.
MOST_BITS = 1 << 16
_LAST = [np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    capital = (data >= 65) & (data <= 90)
    return np.where(capital, data + 32, data).astype(np.uint8)


def shingles(names: np.ndarray, rows: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    if len(names) >= k:
        joined = names[: len(names) - k + 1]
        for i in range(1, k):
            joined = mix(joined) + names[i : len(names) - k + 1 + i]
        joined = mix(joined)
    for start, end in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if end - start >= k:
            yield np.unique(joined[start : end - k + 1])
        elif end > start:
            value = names[start : start + 1]
            for i in range(start + 1, end):
                value = mix(value) + names[i : i + 1]
            yield mix(value ^ _LAST[0] ^ np.uint64(end - start))
        else:
            yield np.zeros(0, np.uint64)


def bands(ratio: float, most: int = 1 << 40) -> np.ndarray:
    """The first size of each band."""
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return np.array(edges)


def blocks_for(apart: int, least: int) -> int:
    """Blocks of a band: apart + 1, and a reserve for those that stay empty."""
    empty = math.exp(-least / (apart + 1))
    return apart + 1 + (math.ceil(3 * empty * (apart + 1)) + 2 if apart else 0)


def blocks(found: np.ndarray, edges: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """The join keys of a set: one per block and band."""
    size = len(found)
    band = int(np.searchsorted(edges, size, "right")) - 1
    for b in (band, band + 1):
        if b > band and 100 * size < percent * int(edges[b]):
            return
        largest = int(edges[b + 1]) - 1
        apart = 2 * largest * (100 - percent) // (100 + percent)
        count = blocks_for(apart, int(edges[b]))
        bit = found % np.uint64(count * BLOCK_BITS)
        block = bit // np.uint64(BLOCK_BITS)
        order = np.argsort(block, kind="stable")
        block, value = block[order], mix(bit[order] ^ _LAST[1])
        head = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        parity = np.zeros(count, np.uint64)
        parity[block[head].astype(np.int64)] = np.bitwise_xor.reduceat(value, head)
        keys = mix(parity ^ mix(np.arange(count, dtype=np.uint64) + np.uint64(b << 40)))
        # At least count - apart blocks of a linked pair are equal. If more than apart blocks are
        # set, one of the set ones is among them and the empty blocks, which many share, may go.
        full = parity != 0
        yield keys[full] if int(full.sum()) > apart else keys


def class_of(found: np.ndarray) -> int:
    """The signed 64-bit name of a set of shingles."""
    name = mix(np.array([np.add.reduce(mix(found ^ _LAST[0])) ^ np.uint64(len(found))]))
    return int(name.view(np.int64)[0])


def short_sketch(found: np.ndarray) -> bytes:
    """A parity sketch of at least four bits a shingle. Its length is a power of two, so that a
    longer one folds to a shorter one by exclusive or."""
    bits = min(max(256, 1 << (4 * len(found) - 1).bit_length()), MOST_BITS)
    hits = np.bincount((mix(found ^ _LAST[1]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((hits & 1).astype(np.uint8)).tobytes()


def sketched(docs: DataFrame, k: int, percent: int, ratio: float = BAND_RATIO) -> DataFrame:
    """(key, cls) per block of each class; ``docs`` has text. Rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = bands(ratio)
        seen: set[int] = set()
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            keys, names, counts = [], [], []
            for found in shingles(*words(lower_ascii(data), offsets), k):
                name = class_of(found) if len(found) else None
                if name is None or name in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(name)
                own = list(blocks(found, edges, percent))
                names.append(name)
                counts.append(sum(map(len, own)))
                keys += own
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            cls = np.repeat(np.array(names, np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(cls)], ["key", "cls"]
            )

    return docs.select("text").mapInArrow(run, "key long, cls long")


def shared_blocks(rows: DataFrame) -> DataFrame:
    """The distinct (key, cls) of keys with several classes, by one pass over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = False  # whether the row held back belongs to the key before it
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            cls = np.concatenate([cls, batch.column("cls").to_numpy()])
            if not len(key):
                continue
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
            key, cls = key[fresh], cls[fresh]
            same = key[1:] == key[:-1]
            before = np.concatenate(([held], same))
            keep = before[:-1] | same
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:-1][keep]), pa.array(cls[:-1][keep])], ["key", "cls"]
            )
            key, cls, held = key[-1:], cls[-1:], bool(before[-1])
        if len(key) and held:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls)], ["key", "cls"])

    dealt = rows.repartition("key").sortWithinPartitions("key", "cls")
    return dealt.mapInArrow(run, "key long, cls long")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(cls, shingles): all distinct shingle hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            sets = [x for x in shingles(*words(lower_ascii(data), offsets), k) if len(x)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            names = pa.array([class_of(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([names, lists], ["cls", "shingles"])

    return docs.select("text").mapInArrow(run, "cls long, shingles array<long>")


def memberships(docs: DataFrame, k: int) -> DataFrame:
    """(doc, node, n_shingles, cls, sketch) per row; cls is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            sets = list(shingles(*words(lower_ascii(data), offsets), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), batch.column("node"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([class_of(x) if len(x) else None for x in sets], pa.int64()),
                    pa.array([short_sketch(x) if len(x) else None for x in sets], pa.binary()),
                ],
                ["doc", "node", "n_shingles", "cls", "sketch"],
            )

    return docs.mapInArrow(
        run, "doc long, node long, n_shingles long, cls long, sketch binary"
    )


def _near(sizes: np.ndarray, sketches: list[bytes], percent: int) -> Iterator[tuple]:
    """(i, js, distances) per row: the rows before it whose sketches are near enough."""
    width = min(map(len, sketches))
    rows = np.stack([
        np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0)
        for x in sketches
    ])
    low, high = 100 * sizes, percent * sizes
    for i in range(1, len(rows)):
        limit = (sizes[:i] + sizes[i]) * (100 - percent) // (100 + percent)
        js = np.flatnonzero((low[:i] >= high[i]) & (low[i] >= high[:i]))
        if len(js):
            apart = np.bitwise_count(rows[js] ^ rows[i]).sum(axis=1, dtype=np.int64)
            near = apart <= limit[js]
            if near.any():
                yield i, js[near], apart[near]


def _forest(cell: dict, percent: int) -> Iterator[tuple[int, int]]:
    """Edges that connect what is near in a cell and not yet of one label."""
    names, labels = cell["cls"], cell["label"].copy()
    for i, js, apart in _near(cell["n_shingles"], cell["sketch"], percent):
        js = js[np.argsort(apart, kind="stable")]
        kinds, first = np.unique(labels[js], return_index=True)
        for kind, at in zip(kinds.tolist(), first.tolist(), strict=True):
            if kind != labels[i]:
                yield names[js[at]], names[i]
        labels[np.isin(labels, kinds)] = labels[i]


def _all_apart(cell: dict, percent: int) -> Iterator[tuple[int, int]]:
    """All near pairs of different labels."""
    names, labels = cell["cls"], cell["label"]
    for i, js, _ in _near(cell["n_shingles"], cell["sketch"], percent):
        for j in js[labels[js] != labels[i]].tolist():
            yield names[j], names[i]


def compared(cells: DataFrame, percent: int, forest: bool) -> DataFrame:
    """(a, b): pairs to verify; ``cells`` has key, lo, hi, cls, label, n_shingles, sketch."""
    choose = _forest if forest else _all_apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(table: pa.Table, most: int) -> Iterator[tuple[int, int]]:
            cuts = _starts(table)
            column = {c: table.column(c).to_numpy() for c in ("cls", "label", "n_shingles")}
            sketches = table.column("sketch").to_pylist()
            for start, end in zip(cuts[:most], [*cuts[1:], table.num_rows][:most], strict=True):
                cell = {c: v[start:end] for c, v in column.items()}
                if len(np.unique(cell["label"])) > 1:
                    yield from choose(cell | {"sketch": sketches[start:end]}, percent)

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(found, np.int64).reshape(-1, 2)
            ends.sort(axis=1)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            # The last cell may go on in the next batch.
            cuts = _starts(table)
            yield out(list(pairs(table, len(cuts) - 1)))
            rest = table.slice(cuts[-1])
        if rest is not None:
            yield out(list(pairs(rest, 1)))

    dealt = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cls")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _starts(table: pa.Table) -> list[int]:
    parts = [table.column(c).to_numpy() for c in ("key", "lo", "hi")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in parts])
    return np.flatnonzero(new).tolist()


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones among ``pairs`` (a, b), by whole sets of the texts of one row per class."""
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    nodes = (
        members.join(broadcast_if_small(stored(ends)), "cls", "left_semi")
        .groupBy("cls").agg(F.min("node").alias("node")).select("node")
    )
    texts = docs.select("node", "text").join(broadcast_if_small(stored(nodes)), "node", "left_semi")
    sets = stored(shingle_sets(texts, k).dropDuplicates(["cls"]))
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.filter(100 * common >= percent * union).select("a", "b")


def links(docs: DataFrame, members: DataFrame, k: int, percent: int, most: int = CELL) -> DataFrame:
    """(a, b): links of classes with exactly the components of the whole link graph.

    ``docs`` has node and text, ``members`` the rows of ``memberships``.
    """
    groups = stored(shared_blocks(sketched(docs, k, percent)))
    marks = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    kinds = groups.groupBy("key").agg(F.count("*").alias("n"), *marks)
    once = kinds.groupBy("n", "mark1", "mark2").agg(F.min("key").alias("key")).select("key", "n")
    groups = stored(groups.join(broadcast_if_small(stored(once)), "key"))
    inside = broadcast_if_small(stored(groups.select("cls").distinct()))
    sketches = (
        members.join(inside, "cls", "left_semi").dropDuplicates(["cls"])
        .select("cls", "n_shingles", "sketch")
    )
    parts = F.ceil(F.col("n") / most)
    own = F.pmod(F.xxhash64("cls"), parts)
    dealt = groups.select(
        "key", "cls", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other")
    )
    cells = dealt.select(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cls"
    )
    first = cells.withColumn("label", F.col("cls")).join(sketches, "cls")
    pairs = stored(compared(first, percent, forest=True))
    found = stored(verified(pairs, docs, members, k, percent))
    labels = components(found).withColumnRenamed("v", "cls")
    labelled = cells.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    again = compared(labelled.join(sketches, "cls"), percent, forest=False)
    again = stored(again.join(pairs, ["a", "b"], "left_anti"))
    if again.isEmpty():
        return found
    return stored(found.union(verified(again, docs, members, k, percent)))


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc, node, n_shingles, component_id) per row of ``docs``.

    doc is the id, with ``NULL_ID`` for null, and component_id the smallest in its component.
    """
    keyed = docs.select(doc_key().alias("doc"), text_version().alias("ver"), "text")
    keyed = keyed.select("doc", F.xxhash64("doc", "ver").alias("node"), "text")
    members = stored(memberships(keyed, k))
    labels = components(links(keyed, members, k, percent)).withColumnRenamed("v", "cls")
    rows = members.select("doc", "node", "n_shingles", "cls")
    # One row per class with links or copies; all others are components of their own.
    low = rows.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc").alias("low"), F.count("*").alias("n")
    )
    grouped = stored(
        low.join(broadcast_if_small(stored(labels)), "cls", "left").filter("n > 1 OR label IS NOT NULL")
        .select("cls", "low", F.coalesce("label", "cls").alias("label"))
    )
    component = grouped.groupBy("label").agg(F.min("low").alias("component"))
    named = stored(
        grouped.join(broadcast_if_small(stored(component)), "label").select("cls", "component")
    )
    return rows.join(broadcast_if_small(named), "cls", "left").select(
        "doc", "node", "n_shingles", F.coalesce("component", "doc").alias("component_id")
    )


def joined(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    none = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    rows = classes(docs, k, percent).withColumnRenamed("doc", "doc_id")
    return rows.select(none("doc_id"), "n_shingles", none("component_id"))


def representatives(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row of each group of ``docs``: the smallest node of the smallest doc_id."""
    rows = stored(classes(docs, k, percent)).filter("n_shingles > 0")
    first = rows.filter("doc = component_id").groupBy("component_id").agg(F.min("node").alias("first"))
    placed = rows.groupBy("node", "component_id").agg(F.count("*").alias("n"))
    # Nodes that leave, and those that stay but are repeated with id and text.
    marked = stored(
        placed.join(first, "component_id")
        .select(F.col("node").alias("__node"), (F.col("node") == F.col("first")).alias("__stays"), "n")
        .filter("NOT __stays OR n > 1")
    )
    gone = broadcast_if_small(marked.filter("NOT __stays").select("__node"))
    again = stored(marked.filter("__stays").select("__node"))
    kept = docs.withColumn("__node", F.xxhash64(doc_key(), text_version()))
    kept = kept.join(gone, "__node", "left_anti")
    if again.isEmpty():
        return kept.drop("__node")
    same = broadcast_if_small(again)
    repeated = kept.join(same, "__node", "left_semi").dropDuplicates(["__node"])
    return kept.join(same, "__node", "left_anti").unionByName(repeated).drop("__node")
