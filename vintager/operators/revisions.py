"""History revisions: each row against the last publication its series appeared in."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.columns import (
    AVAILABLE,
    DEFAULT,
    DIRECTION,
    GROUP_CHANGED,
    LATEST_MW,
    LATEST_TIME,
    PREVIOUS_GROUP,
    PREVIOUS_MW,
    PREVIOUS_TIME,
    REVISION,
    Columns,
)
from vintager.functions.scalars import direction
from vintager.operators.neighbours import AUTO, resolve_chunk, with_predecessor


def _revised(rows: DataFrame, published: str, measure: str) -> DataFrame:
    renamed = rows.withColumnsRenamed({published: LATEST_TIME, measure: LATEST_MW})
    return renamed.withColumn(
        REVISION, F.col(LATEST_MW) - F.col(PREVIOUS_MW)
    ).withColumn(DIRECTION, direction(F.col(REVISION)))


def entity_revisions(
    df: DataFrame, c: Columns = DEFAULT, chunk: str | None = AUTO
) -> DataFrame:
    """Revision of each entity and target date since its series last appeared.

    A change of group keeps the series and is flagged.
    """
    rows = with_predecessor(
        df,
        c.entity_series,
        c.published,
        {PREVIOUS_TIME: c.published, PREVIOUS_MW: c.measure, PREVIOUS_GROUP: c.group},
        chunk,
    )
    return _revised(rows, c.published, c.measure).withColumn(
        GROUP_CHANGED, ~F.col(c.group).eqNullSafe(F.col(PREVIOUS_GROUP))
    )


def series_revisions(
    history: DataFrame,
    series: Sequence[str],
    c: Columns = DEFAULT,
    chunk: str | None = AUTO,
) -> DataFrame:
    """Revision of an aggregated history, per series of ``series`` columns."""
    rows = with_predecessor(
        history,
        series,
        c.published,
        {PREVIOUS_TIME: c.published, PREVIOUS_MW: AVAILABLE},
        resolve_chunk(history, c.published, chunk),
    )
    return _revised(rows, c.published, AVAILABLE)


def revised_series(df: DataFrame, series: Sequence[str], c: Columns = DEFAULT) -> DataFrame:
    """The series with any revision, and the publication of their last one.

    A series of two or more rows is revised by its last row, so no window is needed:
    this is one hash aggregation with map-side combine.
    """
    return (
        df.groupBy(*series)
        .agg(F.max(c.published).alias(LATEST_TIME), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )


def _recent(
    df: DataFrame,
    series: Sequence[str],
    hours: int,
    c: Columns,
    build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``trailing(build(df), hours)`` without revising the whole history.

    The window ends at the newest revision of any series. A series is revised inside
    it if its last revision is, so the target dates of those series bound what must be
    read: only rows of these dates are revised, and both bounds reach the scan. End and
    bounds come from one subquery, whose array holds one entry per target date.
    """
    target = F.col(c.target)
    by_date = (
        revised_series(df, series, c).groupBy(c.target).agg(F.max(LATEST_TIME).alias("_last"))
    )
    dates = by_date.agg(
        F.max("_last").alias("_end"), F.array_agg(F.struct("_last", target.alias("_day"))).alias("_all")
    )
    length = F.expr(f"INTERVAL {int(hours)} HOURS")
    touched_days = F.transform(
        F.filter("_all", lambda day: day["_last"] > F.col("_end") - length),
        lambda day: day["_day"],
    )
    span = dates.select(
        F.struct(
            (F.col("_end") - length).alias("start"),
            F.array_min(touched_days).alias("low"),
            F.array_max(touched_days).alias("high"),
        )
    ).scalar()
    touched = df.filter(
        target.isNull()
        | ((target >= span.getField("low")) & (target <= span.getField("high")))
    )
    return build(touched).filter(F.col(LATEST_TIME) > span.getField("start"))


def recent_entity_revisions(
    df: DataFrame, hours: int = 24, c: Columns = DEFAULT, chunk: str | None = AUTO
) -> DataFrame:
    """The entity revisions of the trailing window, from canonical rows."""
    unit = resolve_chunk(df, c.published, chunk, c.entity_series)
    return _recent(
        df, c.entity_series, hours, c, lambda rows: entity_revisions(rows, c, unit)
    )


def recent_series_revisions(
    history: DataFrame,
    series: Sequence[str],
    hours: int = 24,
    c: Columns = DEFAULT,
    chunk: str | None = AUTO,
) -> DataFrame:
    """The aggregate revisions of the trailing window, from an aggregated history."""
    unit = resolve_chunk(history, c.published, chunk)
    return _recent(
        history, series, hours, c, lambda rows: series_revisions(rows, series, c, unit)
    )


def changed_rows_by_pair(revisions: DataFrame) -> DataFrame:
    """Number of changed rows for each (previous, latest) publication pair that occurs."""
    changed = F.count_if(F.col(REVISION) != 0)
    return revisions.groupBy(PREVIOUS_TIME, LATEST_TIME).agg(changed.alias("changedRows"))


def group_changes(revisions: DataFrame) -> DataFrame:
    return revisions.filter(F.col(GROUP_CHANGED))
