"""Helpers shared by the operators: tables, written intermediates, words and hashes in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintager.session import ensure_checkpoint_dir

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that numpy works on at once; bounds a worker's arrays.
SLICE_BYTES = 1 << 20
# Items that are gathered at once.
GATHERED = 4 * SLICE_BYTES
# A missing doc_id is ordered before every other.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver did.
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [home, env.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared checkpoint folder; later jobs read it and recompute nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``stored``, as a compressed Parquet table: less disk where columns are numbers."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{shared}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # What the write shuffled is not read again; Spark removes it once the driver forgets it.
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_version(column: str = "text") -> Column:
    """Tells apart rows that share a doc_id but not their text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def once(value: Column) -> Column:
    """``value``, computed where it is written.

    The optimizer copies a deterministic expression into whatever reads it, also into the body of a
    lambda, where it would be computed again for every element.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    _, where, raw = array.buffers()
    if where is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if raw is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; one row is never cut."""
    for batch in batches:
        array = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))
BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        grown = np.full(size, base, np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class Ranges:
    """64-bit names of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values)), out=self.sums[1:])
        self.shift = powers(len(values) + 1, _BASE_INVERSE)

    def names(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.shift[starts]
        return mix(value ^ mix((ends - starts).astype(np.uint64)))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word, in order, and the offsets of each row's words."""
    solid = ~_SPACE[data]
    after = np.ones(len(data), bool)
    after[1:] = ~solid[:-1]
    after[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & after)
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    first = np.searchsorted(np.flatnonzero(solid), starts)
    inside = data[solid]
    lengths = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    terms = BYTE_HASH[inside] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, first) ^ lengths.astype(np.uint64)), rows


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    if ends[-1] > GATHERED and len(ends) > 1:
        # The places take eight bytes each; a long text is gathered in parts.
        halves = np.array_split(starts, 2), np.array_split(lengths, 2)
        return np.concatenate([gathered(flat, *x) for x in zip(*halves, strict=True)])
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class Pieces:
    """Byte strings by number, laid end to end."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of these numbers as one array of bytes, and where each ends."""
        lengths = self.lengths[numbers]
        return gathered(self.data, self.starts[numbers], lengths), np.cumsum(lengths)


class Remembered:
    """The ids of parts of texts, kept for the next occurrence of a part within a bound.

    ``encode`` gives the ids of parts as the bytes of 32-bit integers.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]]):
        self.encode = encode
        self.known: dict[str, bytes] = {}

    def ids(
        self, data: np.ndarray, starts: np.ndarray, rows: np.ndarray, most: int, longest: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and the offsets of each row's.

        The parts are the UTF-8 bytes from each start to the next, the first start and those of
        rows that are not empty among them. About ``most`` parts of up to ``longest`` characters
        are kept.
        """
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        bounds = np.append(starts, len(data)).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        if len(known) > most:
            known.clear()
        raw = list(map(known.get, distinct))
        missing = [k for k, ids in enumerate(raw) if ids is None]
        new = [distinct[k] for k in missing]
        for k, x, ids in zip(missing, new, self.encode(new), strict=True):
            raw[k] = ids
            if len(x) <= longest:
                known[x] = ids
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        begins = np.cumsum(lengths) - lengths
        place = coded.indices.to_numpy()
        lengths = lengths[place]
        flat = gathered(np.frombuffer(b"".join(raw), np.int32), begins[place], lengths)
        return flat, np.append(0, np.cumsum(lengths))[np.searchsorted(starts, rows)]


def joined_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 bytes, and the offsets of each."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of ``edges`` (a, b): label is the smallest v of its component.

    Minima move along edges and then jump to the label's own label, so a path of length n takes
    about log n rounds; each round is written, and none gathers a component anywhere.
    """
    both = stored(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct()
    )
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select(
        "v", F.least("v", "m").alias("label")
    ))
    while True:
        near = (
            both.join(labels.withColumnRenamed("v", "b"), "b")
            .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("seen"))
        )
        lower = labels.join(near, "v").select(
            "v", "label", F.least("label", "seen").alias("low")
        )
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("far"))
        after = stored(
            lower.join(jump, "low", "left").select(
                "v", "label", F.least("low", F.coalesce("far", "low")).alias("next")
            )
        )
        moved = not after.filter("label <> next").isEmpty()
        labels = after.select("v", F.col("next").alias("label"))
        if not moved:
            return labels
