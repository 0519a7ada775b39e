"""Pair revisions: each publication against the immediately preceding one.

Two sides of a pair match on entity, group and target date, so a matched row's
predecessor in its (entity, group, date) series is its row in the previous
publication. Matching is therefore one window over one shuffle, not a self-join of
the history: the predecessor is kept where it comes from the adjacent publication.
NULL keys match NULL keys, and a repeated key shows as a predecessor of the same
publication, which is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintager.columns import (
    ABS_REVISION,
    BECAME_UNAVAILABLE,
    DEFAULT,
    LATEST_MW,
    LATEST_TIME,
    PAIR_DIRECTION,
    PREVIOUS_MW,
    PREVIOUS_TIME,
    RETURNED_AVAILABLE,
    REVISION,
    Columns,
)
from vintager.functions.scalars import (
    became_unavailable,
    is_changed,
    pair_direction,
    returned_available,
)
from vintager.operators.neighbours import AUTO, resolve_chunk, with_predecessor
from vintager.operators.publications import (
    PREVIOUS,
    at_time,
    publication_calendar,
    publications,
)
from vintager.operators.sizing import BROADCAST_ROWS, broadcast_if_small
from vintager.session import ensure_checkpoint_dir


class NoCommonDates(ValueError):
    """Raised when two publications share no target date."""


def _unique(value: Column, earlier: Column, later: Column) -> Column:
    """``value``, or an error if the predecessor is of the row's own publication.

    The check is part of a value, not a filter: the optimizer copies filters to the
    other side of a join, where rows that are not predecessors would raise.
    """
    message = "Pair keys are not unique: entity, group and target date repeat."
    return F.when(earlier == later, F.raise_error(message).cast("timestamp")).otherwise(value)


def _revised(matched: DataFrame, c: Columns) -> DataFrame:
    before, after, change = F.col(PREVIOUS_MW), F.col(LATEST_MW), F.col(REVISION)
    return (
        matched.withColumn(REVISION, after - before)
        .withColumns(
            {
                ABS_REVISION: F.abs(change),
                PAIR_DIRECTION: pair_direction(change),
                BECAME_UNAVAILABLE: became_unavailable(before, after),
                RETURNED_AVAILABLE: returned_available(before, after),
            }
        )
        .select(
            c.entity,
            c.group,
            c.target,
            PREVIOUS_TIME,
            PREVIOUS_MW,
            LATEST_TIME,
            LATEST_MW,
            REVISION,
            ABS_REVISION,
            PAIR_DIRECTION,
            BECAME_UNAVAILABLE,
            RETURNED_AVAILABLE,
        )
    )


def adjacent_pairs(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Every publication with the one before it."""
    return (
        publication_calendar(df, c)
        .filter(F.col(PREVIOUS).isNotNull())
        .select(F.col(PREVIOUS).alias(PREVIOUS_TIME), F.col(c.published).alias(LATEST_TIME))
    )


def _known_pairs(df: DataFrame, c: Columns) -> DataFrame:
    """The adjacent pairs, broadcast if a count of the publications bounds them."""
    few = publications(df, c).count() <= BROADCAST_ROWS
    pairs = adjacent_pairs(df, c)
    return F.broadcast(pairs) if few else pairs


def all_pair_revisions(
    df: DataFrame, c: Columns = DEFAULT, chunk: str | None = AUTO
) -> DataFrame:
    """Revisions of every adjacent pair of publications at once."""
    pairs = _known_pairs(df, c)
    keys = [c.entity, c.group, c.target]
    dated = df.filter(F.col(c.target).isNotNull() & F.col(c.published).isNotNull())
    rows = with_predecessor(
        dated.select(*keys, c.published, c.measure),
        keys,
        c.published,
        {PREVIOUS_TIME: c.published, PREVIOUS_MW: c.measure},
        chunk,
    ).withColumnsRenamed({c.published: LATEST_TIME, c.measure: LATEST_MW})
    previous, latest = F.col(PREVIOUS_TIME), F.col(LATEST_TIME)
    checked = rows.withColumn(PREVIOUS_TIME, _unique(previous, previous, latest))
    return _revised(checked.join(pairs, [PREVIOUS_TIME, LATEST_TIME], "left_semi"), c)


def restrict_to_dates(df: DataFrame, dates: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Rows of the given target dates; the list is broadcast if a count proves it short."""
    return df.join(broadcast_if_small(dates), c.target, "left_semi")


def pair_revisions(previous: DataFrame, latest: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Revisions between two given publications; an error if no target date is common."""
    shared = common_dates(previous, latest, c)
    if shared.isEmpty():
        raise NoCommonDates("The two publications have no target date in common.")
    return match_publications(
        restrict_to_dates(previous, shared, c), restrict_to_dates(latest, shared, c), c
    )


def match_publications(previous: DataFrame, latest: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """As ``pair_revisions``, but without rows where dates or units do not match."""
    keys = [c.entity, c.group, c.target]

    def side(df: DataFrame, number: int) -> DataFrame:
        dated = df.filter(F.col(c.target).isNotNull())
        return dated.select(*keys, c.published, c.measure, F.lit(number).alias("_side"))

    # At most the two sides of one key meet in a window partition.
    window = Window.partitionBy(*keys).orderBy("_side")
    rows = (
        side(previous, 0)
        .unionByName(side(latest, 1))
        .withColumns(
            {
                "_earlier": F.lag("_side").over(window),
                PREVIOUS_TIME: F.lag(c.published).over(window),
                PREVIOUS_MW: F.lag(c.measure).over(window),
            }
        )
        .filter(F.col("_earlier").isNotNull())
        .withColumn(
            PREVIOUS_TIME, _unique(F.col(PREVIOUS_TIME), F.col("_earlier"), F.col("_side"))
        )
        .withColumnsRenamed({c.published: LATEST_TIME, c.measure: LATEST_MW})
    )
    return _revised(rows, c)


def latest_pair_revisions(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Revisions between the two newest publications; no rows if there are fewer."""
    newest_two = publications(df, c).orderBy(F.col(c.published).desc()).limit(2)
    span = newest_two.agg(
        F.when(
            F.count(F.lit(1)) == 2,
            F.struct(F.min(c.published).alias("earlier"), F.max(c.published).alias("later")),
        ).alias("span")
    ).scalar()
    return match_publications(
        at_time(df, c.published, span.getField("earlier")),
        at_time(df, c.published, span.getField("later")),
        c,
    )


def newest_pair_revisions(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """The revisions of the newest adjacent pair that has any; no rows if none has.

    Publications are taken newest first and only the rows of two of them are matched, so a
    history of any length costs one column for its publication times and the two
    publications, again for each pair that is passed over. The matched rows are written once,
    as whether there are any decides.
    """
    ensure_checkpoint_dir(df.sparkSession)
    times = publications(df, c).select(F.unix_micros(c.published).alias("at")).checkpoint()

    def newest_before(bound: int | None) -> int | None:
        known = times if bound is None else times.filter(F.col("at") < bound)
        return known.agg(F.max("at")).first()[0]

    def rows_at(instant: int) -> DataFrame:
        return at_time(df, c.published, F.timestamp_micros(F.lit(instant)))

    later = newest_before(None)
    while later is not None:
        earlier = newest_before(later)
        if earlier is None:
            break
        rows = match_publications(rows_at(earlier), rows_at(later), c).checkpoint()
        if not rows.isEmpty():
            return rows
        later = earlier
    return match_publications(df.limit(0), df.limit(0), c)


def newest_revised_pair(unit_revisions: DataFrame) -> DataFrame:
    """The same of stored revisions; publications without a match have none there.

    The pair is a scalar subquery, so the rows are filtered without a join.
    """
    newest = unit_revisions.agg(F.max(F.struct(LATEST_TIME, PREVIOUS_TIME))).scalar()
    same = [F.col(name) == newest.getField(name) for name in (LATEST_TIME, PREVIOUS_TIME)]
    return unit_revisions.filter(same[0] & same[1])


def rollup_pair(unit_revisions: DataFrame, groups: Sequence[str] = (), c: Columns = DEFAULT) -> DataFrame:
    """Sums and unit counters of matched revisions by pair, target date and groups.

    Only matched entities enter, so the group and system levels reconcile with the
    entity level. Rows with a NULL group are left out; unknown measures sum to 0.
    """
    rows = unit_revisions
    for group in groups:
        rows = rows.filter(F.col(group).isNotNull())

    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    return rows.groupBy(PREVIOUS_TIME, LATEST_TIME, c.target, *groups).agg(
        total(PREVIOUS_MW),
        total(LATEST_MW),
        total(REVISION),
        F.count_if(is_changed(F.col(REVISION))).alias("changedUnits"),
        F.count_if(BECAME_UNAVAILABLE).alias("becameUnavailableUnits"),
        F.count_if(RETURNED_AVAILABLE).alias("returnedAvailableUnits"),
    )


def common_dates(previous: DataFrame, latest: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Target dates present in both."""

    def dates(df: DataFrame) -> DataFrame:
        return df.select(c.target).filter(F.col(c.target).isNotNull())

    return dates(previous).intersect(dates(latest))


def pair_overlap(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Number of common target dates of every adjacent pair, 0 where there is none.

    Works on one row per publication and date: a date is common to a pair if its
    previous publication is the adjacent one.
    """
    pairs = _known_pairs(df, c)
    dates = df.select(c.published, c.target).filter(
        F.col(c.published).isNotNull() & F.col(c.target).isNotNull()
    ).distinct()
    rows = with_predecessor(
        dates, [c.target], c.published, {PREVIOUS_TIME: c.published},
        resolve_chunk(dates, c.published, AUTO),
    )
    common = rows.groupBy(PREVIOUS_TIME, F.col(c.published).alias(LATEST_TIME)).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return pairs.join(common, [PREVIOUS_TIME, LATEST_TIME], "left").select(
        PREVIOUS_TIME, LATEST_TIME, F.coalesce("_n", F.lit(0)).alias("commonDates")
    )


def changed_rows_by_adjacent_pair(unit_revisions: DataFrame) -> DataFrame:
    return unit_revisions.groupBy(PREVIOUS_TIME, LATEST_TIME).agg(
        F.count_if(is_changed(F.col(REVISION))).alias("changedRows")
    )


def top_pair_movers(
    unit_revisions: DataFrame, upward: bool, limit: int = 10, c: Columns = DEFAULT
) -> DataFrame:
    """The largest upward (or downward) revisions, ties by target date and entity."""
    change = F.col(REVISION)
    moved = unit_revisions.filter(change > 0 if upward else change < 0)
    return (
        moved.orderBy(change.desc() if upward else change.asc(), c.target, c.entity)
        .limit(limit)
        .select(c.target, c.entity, c.group, PREVIOUS_MW, LATEST_MW, REVISION)
    )
