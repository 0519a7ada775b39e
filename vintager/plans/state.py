"""Stored revisions that serving products read, kept up to date publication by publication.

Three versioned tables partitioned by the date of the later publication: unit revisions, group
revisions, and one line per date with its revisions counted by direction. A refresh revises
what new publications add or change, also when they arrive late, and counts the dates it
touched anew. A trailing window then reads the last days' files, and all-history counts read
one line per date.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintager.columns import (
    DEFAULT,
    DIRECTION,
    LATEST_TIME,
    PREVIOUS_TIME,
    PUBLISH_DATE,
    REVISION,
    Columns,
)
from vintager.functions.scalars import UNCHANGED, share_or_zero
from vintager.operators.availability import group_history
from vintager.operators.publications import trailing
from vintager.operators.revisions import series_revisions
from vintager.operators.sizing import broadcast_if_small
from vintager.plans import serving
from vintager.sources.tables import upsert
from vintager.sources.versions import NO_DAY, days_of, read_version, version
from vintager.streaming.publications import affected_revisions, touched_dates

DAY = "revision_day"
DIRECTIONS = ["up", "down", UNCHANGED]


@dataclass
class RevisionState:
    """Paths of the tables under one root."""

    root: str
    units: str = field(init=False)
    groups: str = field(init=False)
    days: str = field(init=False)

    def __post_init__(self) -> None:
        self.units = f"{self.root}/unit_revisions"
        self.groups = f"{self.root}/group_revisions"
        self.days = f"{self.root}/revision_days"


def affected_groups(history: DataFrame, times: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Group revisions that publications ``times`` add or change.

    Only target dates that they mention are aggregated and revised.
    """
    low, high = touched_dates(history, times, c)
    target = F.col(c.target)
    touched = history.filter(target.isNull() | target.between(low, high))
    revised = series_revisions(group_history(touched, c), c.group_series, c)
    for name, flag in ((LATEST_TIME, "_is_new"), (PREVIOUS_TIME, "_follows_new")):
        listed = times.select(F.col(c.published).alias(name), F.lit(True).alias(flag))
        revised = revised.join(broadcast_if_small(listed), name, "left")
    return revised.filter("_is_new OR _follows_new").drop("_is_new", "_follows_new")


def refresh(
    spark: SparkSession,
    state: RevisionState,
    history: DataFrame,
    times: DataFrame,
    c: Columns = DEFAULT,
) -> dict[str, int]:
    """Bring the tables up to date with publications ``times`` of ``history``.

    The tables change one after the other; a run that dies in between is finished by calling
    it again with the same times, which changes nothing that is done.
    """
    units = affected_revisions(history, times, c).checkpoint()
    counts = {"unit_rows": upsert(spark, state.units, units, [*c.entity_series, LATEST_TIME], LATEST_TIME)}
    groups = affected_groups(history, times, c)
    counts["group_rows"] = upsert(
        spark, state.groups, groups, [*c.group_series, LATEST_TIME], LATEST_TIME
    )
    touched = days_of(units.select(F.to_date(LATEST_TIME).alias(PUBLISH_DATE)))
    if touched:
        lines = day_lines(read_version(spark, state.units, days=touched))
        counts["days"] = upsert(spark, state.days, lines, [DAY], DAY)
    return counts


def day_lines(units: DataFrame) -> DataFrame:
    """Revisions of each date by direction; one line per date."""
    return units.groupBy(F.col(PUBLISH_DATE).alias(DAY)).agg(
        *[F.count_if(F.col(DIRECTION) == name).alias(name) for name in DIRECTIONS],
        F.coalesce(F.sum(REVISION), F.lit(0)).alias("net"),
    )


def recent(spark: SparkSession, path: str, hours: int = 24) -> DataFrame:
    """The trailing window of a stored revision table; other days' files are not listed."""
    state = version(spark, path)
    dated = [day for day in state.live if day != NO_DAY]
    if not dated:
        raise FileNotFoundError(f"No revisions are stored under {path}.")
    first = date.fromisoformat(max(dated)) - timedelta(days=math.ceil(hours / 24))
    days = [day for day in dated if day >= first.isoformat()]
    return trailing(read_version(spark, path, state, days), hours).drop(PUBLISH_DATE)


def direction_counts(spark: SparkSession, state: RevisionState) -> DataFrame:
    """As ``serving.direction_counts`` over all stored revisions, from one line per date."""
    total = F.col("up") + F.col("down") + F.col(UNCHANGED)
    pairs = [F.struct(F.lit(n).alias("direction"), F.col(n).alias("count")) for n in DIRECTIONS]
    return (
        read_version(spark, state.days)
        .agg(*[F.sum(name).alias(name) for name in DIRECTIONS])
        .select(total.alias("_all"), F.inline(F.array(*pairs)))
        .filter(F.col("count") > 0)
        .select(
            "direction", "count", share_or_zero(F.col("count"), F.col("_all"), 2).alias("share_pct")
        )
    )


def stability(
    spark: SparkSession,
    state: RevisionState,
    hours: int = 24,
    dimension: DataFrame | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """As ``serving.stability``: the dates' lines, and the last days of both revision tables."""
    counted = read_version(spark, state.days).agg(
        F.coalesce(F.sum(UNCHANGED), F.lit(0)).alias("_same"),
        F.coalesce(F.sum(F.col("up") + F.col("down") + F.col(UNCHANGED)), F.lit(0)).alias("_all"),
    )
    return serving.stability_of(
        counted, recent(spark, state.units, hours), recent(spark, state.groups, hours), dimension, c
    )
