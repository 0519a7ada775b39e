"""Order-based operators that no hot key can turn into one long task.

``lag`` and ``row_number`` send a whole window partition to one task. Both
operators here bound that. Predecessors use a plain window while a count proves every
series short, and else look inside time chunks, with only the chunk edges meeting
again. Ranks come from a range partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintager.operators.sizing import broadcast_if_small
from vintager.session import ensure_checkpoint_dir

AUTO = "auto"
CHUNK_UNITS = ["YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"]
# Rows of one series that a single task may order.
SERIES_ROWS = 1_000_000


def chunk_unit(
    df: DataFrame,
    order: str,
    max_rows: int | None = None,
    series: Sequence[str] | None = None,
) -> str | None:
    """The largest time unit that keeps every series within ``max_rows`` rows per unit.

    With ``series`` the rows themselves are counted, so that NULL keys and repeated keys,
    which may put any number of rows into one series, are seen: the whole count first, then
    one aggregation with map-side combine. Without, the rows are unique per series and
    ``order``, as aggregated histories are, and the number of distinct ``order`` values is the
    bound. ``None`` means no chunking is needed. Beyond the smallest unit a series holds one
    key many times over, which the quality verdict refuses.
    """
    most = SERIES_ROWS if max_rows is None else max_rows
    if series is None:
        df, keys = df.select(order).distinct(), []
        longest = df.count()
    else:
        keys = list(series)
        longest = df.count()
        if longest > most:
            longest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if longest <= most:
        return None
    for unit in CHUNK_UNITS[:-1]:
        per_unit = df.groupBy(*keys, F.date_trunc(unit, F.col(order)).alias("_unit")).count()
        if per_unit.agg(F.max("count")).first()[0] <= most:
            return unit
    return CHUNK_UNITS[-1]


def resolve_chunk(
    df: DataFrame, order: str, chunk: str | None, series: Sequence[str] | None = None
) -> str | None:
    return chunk_unit(df, order, series=series) if chunk == AUTO else chunk


def with_predecessor(
    df: DataFrame,
    series: Sequence[str],
    order: str,
    carry: dict[str, str],
    chunk: str | None = AUTO,
) -> DataFrame:
    """Keep the rows that have an earlier row in their series, with its values added.

    ``carry`` maps new column names to source columns and must carry ``order``
    itself. Without a ``chunk`` this is one window. With one (a ``date_trunc`` unit),
    the window partition is a series within a chunk, and only the first and last row
    of each chunk go through a second window over the whole series, so a long series
    puts two rows per chunk into a task. The result is the same. Both branches read
    one shuffle: the second is a ReusedExchange.
    """
    chunk = resolve_chunk(df, order, chunk, series)
    marker = next(new for new, source in carry.items() if source == order)

    def lagged(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(order)
        return frame.withColumns(
            {new: F.lag(source).over(window) for new, source in carry.items()}
        )

    if chunk is None:
        return lagged(df, series).filter(F.col(marker).isNotNull())

    chunk_keys = [*series, "_chunk"]
    window = Window.partitionBy(*chunk_keys).orderBy(order)
    local = lagged(df.withColumn("_chunk", F.date_trunc(chunk, F.col(order))), chunk_keys)
    is_head = F.col(marker).isNull()

    inside = local.filter(~is_head)
    edges = (
        local.withColumn("_is_tail", F.lead(order).over(window).isNull())
        .filter(is_head | F.col("_is_tail"))
        .withColumn("_is_head", is_head)
        .drop(*carry)
    )
    heads = lagged(edges, series).filter(F.col("_is_head") & F.col(marker).isNotNull())
    return inside.drop("_chunk").unionByName(heads.drop("_chunk", "_is_tail", "_is_head"))


def with_total_rank(
    df: DataFrame, within: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """``row_number`` of every row inside its ``within`` group, whatever the group's size.

    A window would sort each group in one task. Here the rows are range-partitioned
    on the full order, so a large group spreads over many partitions; a row's rank
    is its place in its partition plus the rows of its group in earlier partitions.
    The order must be total for the rank to be unique.

    The ranged rows are checkpointed because both the counting and the ranking must
    see the same partition bounds, also after an executor is lost.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordering = [*(F.col(c) for c in within), *order]
    placed = (
        df.repartitionByRange(*ordering)
        .sortWithinPartitions(*ordering)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_slot", 33))
        .checkpoint()
    )
    runs = placed.groupBy(*within, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_slot").alias("_first")
    )
    # One row per group and partition.
    earlier = (
        Window.partitionBy(*within)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = runs.select(
        *within,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    # NULL groups are groups too.
    side = offsets.withColumnsRenamed({c: f"_of_{c}" for c in [*within, "_part"]})
    same = reduce(
        and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*within, "_part"]]
    )
    return (
        placed.join(broadcast_if_small(side), same)
        .drop(*[f"_of_{c}" for c in [*within, "_part"]])
        .withColumn(name, F.col("_slot") - F.col("_first") + F.col("_before") + 1)
        .drop("_slot", "_part", "_first", "_before")
    )
