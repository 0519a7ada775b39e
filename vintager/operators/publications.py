"""The publication calendar, and rows of the latest publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintager.columns import DEFAULT, LATEST_TIME, PUBLISH_DATE, Columns

PREVIOUS = "previousPublishTime"
NEXT = "nextPublishTime"
NUMBER = "publicationNumber"


class NoPublications(ValueError):
    """Raised where a publication is needed and none is stored."""


def publications(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    return df.select(c.published).filter(F.col(c.published).isNotNull()).distinct()


def publication_calendar(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Each publication with its predecessor, successor and chronological number.

    Neighbours are found inside a day; only one summary row per day passes through
    the window over all days.
    """
    published = F.col(c.published)
    by_day = publications(df, c).withColumn("_day", F.to_date(published))
    days = Window.orderBy("_day")
    summary = (
        by_day.groupBy("_day")
        .agg(
            F.min(published).alias("_first"),
            F.max(published).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(
            "_day",
            F.lag("_last").over(days).alias("_before"),
            F.lead("_first").over(days).alias("_after"),
            F.coalesce(
                F.sum("_n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
        )
    )
    in_day = Window.partitionBy("_day").orderBy(c.published)
    return by_day.join(summary, "_day").select(
        c.published,
        F.coalesce(F.lag(published).over(in_day), F.col("_before")).alias(PREVIOUS),
        F.coalesce(F.lead(published).over(in_day), F.col("_after")).alias(NEXT),
        (F.row_number().over(in_day) + F.col("_offset")).cast("bigint").alias(NUMBER),
    )


def newest(df: DataFrame, time: str) -> Column:
    """Scalar subquery: the largest value of ``time``."""
    source = df
    if PUBLISH_DATE in df.columns:
        source = df.filter(F.col(PUBLISH_DATE) == df.agg(F.max(PUBLISH_DATE)).scalar())
    return source.agg(F.max(time)).scalar()


def at_time(df: DataFrame, time: str, instant: Column) -> DataFrame:
    """Rows at one publication. The equality reaches the scan, and prunes partitions
    when the rows come from a stored table."""
    rows = df.filter(F.col(time) == instant)
    if PUBLISH_DATE in df.columns:
        rows = rows.filter(F.col(PUBLISH_DATE) == F.to_date(instant))
    return rows


def latest_publication(df: DataFrame, c: Columns = DEFAULT, time: str | None = None) -> DataFrame:
    time = time or c.published
    return at_time(df, time, newest(df, time))


def require_publications(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise NoPublications("No stored publications were found.")
    return df


def latest_publications(df: DataFrame, n: int = 2, c: Columns = DEFAULT) -> DataFrame:
    """Rows of the ``n`` newest publications; no rows if fewer than ``n`` exist.

    The bound is the n-th newest publication time, found by a top-n of the
    publication times, so the row filter is one comparison at the scan.
    """
    times = publications(df, c).orderBy(F.col(c.published).desc()).limit(n)
    bound = times.agg(
        F.when(F.count(F.lit(1)) >= n, F.min(c.published)).alias("bound")
    ).scalar()
    rows = df.filter(F.col(c.published) >= bound)
    if PUBLISH_DATE in df.columns:
        rows = rows.filter(F.col(PUBLISH_DATE) >= F.to_date(bound))
    return rows


def nearest_target(df: DataFrame, c: Columns = DEFAULT) -> Column:
    """Scalar subquery: the first target date at or after the latest publication,
    where a date stands for its midnight."""
    latest = latest_publication(df, c)
    return (
        latest.filter(F.col(c.target) >= F.col(c.published)).agg(F.min(c.target)).scalar()
    )


def nearest_forecast(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """The latest publication's rows for the nearest target date."""
    return latest_publication(df, c).filter(F.col(c.target) == nearest_target(df, c))


def trailing(df: DataFrame, hours: int = 24, time: str = LATEST_TIME) -> DataFrame:
    """Rows of the half-open window ``(newest - hours, newest]`` of ``time``."""
    end = newest(df, time)
    start = end - F.expr(f"INTERVAL {int(hours)} HOURS")
    rows = df.filter((F.col(time) > start) & (F.col(time) <= end))
    if PUBLISH_DATE in df.columns:
        rows = rows.filter(F.col(PUBLISH_DATE) >= F.to_date(start))
    return rows
