"""Landing files and selections from them: latest pulls, ranges, lists, splits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintager.columns import DEFAULT, PUBLISH_DATE, Columns
from vintager.functions.scalars import (
    lenient_date,
    lenient_decimal,
    lenient_timestamp,
    utc_instant,
)
from vintager.operators.quality import QualityError, require_rows, single_publication_time
from vintager.operators.sizing import broadcast_if_small
from vintager.schema import LANDING


# Where a row came from: kept until its publication is admitted, never stored.
FILE_TIME, FILE = "_file_time", "_file"


def with_file(raw: DataFrame) -> DataFrame:
    """Rows of a file source with the modification time and path of their file."""
    return raw.select(
        "*",
        F.col("_metadata.file_modification_time").alias(FILE_TIME),
        F.col("_metadata.file_path").alias(FILE),
    )


def parse_landing(raw: DataFrame, c: Columns = DEFAULT, collected: Column | None = None) -> DataFrame:
    """Canonical columns from landing text; values that do not parse become NULL."""
    origin = [name for name in (FILE_TIME, FILE) if name in raw.columns]
    return raw.select(
        c.dataset,
        c.group,
        c.entity,
        c.alias,
        lenient_timestamp(F.col(c.published)).alias(c.published),
        lenient_date(F.col(c.target)).alias(c.target),
        lenient_decimal(F.col(c.measure)).alias(c.measure),
        (F.current_timestamp() if collected is None else collected).alias(c.collected),
        *origin,
    )


def read_landing(
    spark: SparkSession,
    path: str,
    groups: Sequence[str] | None = None,
    entities: Sequence[str] | None = None,
    c: Columns = DEFAULT,
    arrays: bool = True,
    files: bool = False,
) -> DataFrame:
    """JSON records, one or more publications per file.

    A file with one JSON array is read by one task; ``arrays=False`` reads one record
    per line, which large files can be split by. ``files`` keeps each row's file, for
    ``united``.
    """
    raw = spark.read.schema(LANDING).option("multiLine", arrays).json(path)
    raw = with_file(raw) if files else raw
    return select_listed(parse_landing(raw, c), groups, entities, c)


def united(rows: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Each publication once, whichever files its rows lie in, without the files' columns.

    Rows of a publication in several files are put together; of a key that several files
    have, the rows of the first file (by time, then path) stay. A key repeated within one
    file stays repeated, which the ingest verdict rejects.
    """
    origin = F.struct(FILE_TIME, FILE)
    several = (
        rows.groupBy(c.published)
        .agg(F.min(origin).alias("_low"), F.max(origin).alias("_high"))
        .filter((F.col("_low") != F.col("_high")) & F.col(c.published).isNotNull())
        .select(c.published)
    )
    known = broadcast_if_small(several)
    split = rows.join(known, c.published, "left_semi")
    # One row per key on the other side, so adaptive execution can split a hot key.
    first = split.groupBy(*[F.col(k).alias(f"_of_{k}") for k in c.key]).agg(
        F.min(origin).alias("_first")
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in c.key])
    kept = split.join(first, same & (origin == F.col("_first")), "left_semi")
    whole = rows.join(known, c.published, "left_anti")
    return whole.unionByName(kept).drop(FILE_TIME, FILE)


def select_listed(
    df: DataFrame,
    groups: Sequence[str] | None = None,
    entities: Sequence[str] | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """Restrict to listed groups and entities; an empty or absent list keeps all."""
    if groups:
        df = df.filter(F.col(c.group).isin(list(groups)))
    if entities:
        df = df.filter(F.col(c.entity).isin(list(entities)))
    return df


def publish_range(
    df: DataFrame,
    start: datetime | str,
    end: datetime | str,
    groups: Sequence[str] | None = None,
    entities: Sequence[str] | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """Rows published in ``[start, end]``; both bounds are literals, so they prune."""
    low, high = utc_instant(start), utc_instant(end)
    if low >= high:
        raise ValueError("The start of a publication range must be before its end.")
    rows = df.filter(F.col(c.published).between(F.lit(low), F.lit(high)))
    if PUBLISH_DATE in df.columns:
        rows = rows.filter(F.col(PUBLISH_DATE).between(F.lit(low.date()), F.lit(high.date())))
    return select_listed(rows, groups, entities, c)


def split_publications(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Lay rows out by publication, each ordered by target date and entity.

    Rebalancing clusters publications but splits one that is far larger than the
    others. Rows without a publication time are left out.
    """
    if c.published not in df.columns:
        raise QualityError(f"The response has no {c.published} column.")
    return (
        df.filter(F.col(c.published).isNotNull())
        .hint("rebalance", c.published)
        .sortWithinPartitions(c.published, c.target, c.entity)
    )


def publication_summary(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """One line per publication: rows, entities, target dates, groups.

    Rows are first reduced to one per entity and group, so that the distinct counts
    expand the reduced rows only.
    """
    reduced = (
        df.filter(F.col(c.published).isNotNull())
        .groupBy(c.published, c.entity, c.group, c.target)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return reduced.groupBy(c.published).agg(
        F.sum("_n").alias("rows"),
        F.count_distinct(c.entity).alias("units"),
        F.count_distinct(c.target).alias("forecastDates"),
        F.count_distinct(c.group).alias("fuelTypes"),
    )


def one_publication(
    df: DataFrame, published: datetime | str | None = None, c: Columns = DEFAULT
) -> DataFrame:
    """One publication with its types coerced; empty or ambiguous input is an error."""
    rows = df
    if published is not None:
        rows = rows.filter(F.col(c.published) == F.lit(utc_instant(published)))
    types = dict(rows.dtypes)
    if types[c.target] != "date":
        rows = rows.withColumn(c.target, lenient_date(F.col(c.target).cast("string")))
    if types[c.published] != "timestamp":
        rows = rows.withColumn(c.published, lenient_timestamp(F.col(c.published).cast("string")))
    if types[c.measure] == "string":
        rows = rows.withColumn(c.measure, lenient_decimal(F.col(c.measure)))
    require_rows(rows)
    single_publication_time(rows, c)
    return rows
