"""Gold products over the relational tables (availability, pair revisions, audit state).

Where one value of a table restricts another read of it ("the latest publication"),
it is a scalar subquery: the comparison reaches the scan and prunes partitions, which
a join would not. No product needs a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintager.functions.scalars import (
    PAIR_DOWN,
    PAIR_UP,
    duration_seconds,
    is_interconnector,
    share_or_null,
)
from vintager.operators.neighbours import with_total_rank
from vintager.operators.publications import at_time, newest

PAIR = ("previous_publish_time", "latest_publish_time")


def availability_outlook(by_group: DataFrame) -> DataFrame:
    """The latest publication by target date: total, interconnectors, own generation.

    ``bm_unit_records`` adds up per-group distinct counts, so a unit listed under two
    groups counts twice.
    """
    latest = at_time(by_group, "publish_time", newest(by_group, "publish_time"))
    mw = F.col("available_mw")
    abroad = is_interconnector(F.col("fuel_type"))
    return latest.groupBy("publish_time", "forecast_date").agg(
        F.sum(mw).alias("total_available_mw"),
        F.sum(F.when(abroad, mw).otherwise(0)).alias("interconnector_available_mw"),
        F.sum(F.when(~abroad, mw).otherwise(0)).alias("gb_generation_storage_available_mw"),
        F.sum("bm_units").alias("bm_unit_records"),
        F.sum("zero_availability_units").alias("zero_availability_units"),
    )


def availability_mix(outlook: DataFrame) -> DataFrame:
    total = F.col("total_available_mw")
    own = F.col("gb_generation_storage_available_mw")
    abroad = F.col("interconnector_available_mw")
    return outlook.select(
        "publish_time",
        "forecast_date",
        total,
        own,
        abroad,
        share_or_null(own, total).alias("gb_generation_storage_pct"),
        share_or_null(abroad, total).alias("interconnector_pct"),
        "zero_availability_units",
    )


def latest_pair(revisions: DataFrame) -> DataFrame:
    """The newest pair that has revisions; ties of the later side go to the newer earlier side."""
    previous, latest = PAIR
    return (
        revisions.select(*PAIR)
        .orderBy(F.col(latest).desc(), F.col(previous).desc())
        .limit(1)
    )


def _in_latest_pair(revisions: DataFrame) -> DataFrame:
    previous, latest = PAIR
    pair = revisions.agg(F.max(F.struct(latest, previous))).scalar()
    return revisions.filter(
        (F.col(latest) == pair.getField(latest)) & (F.col(previous) == pair.getField(previous))
    )


def latest_system_revision(system_revisions: DataFrame) -> DataFrame:
    return _in_latest_pair(system_revisions)


def latest_changed_units(unit_revisions: DataFrame) -> DataFrame:
    return _in_latest_pair(unit_revisions).filter(F.col("revision_mw") != 0)


def fuel_revision_ranking(group_revisions: DataFrame) -> DataFrame:
    """Changed groups of the latest pair ranked per target date.

    One row per group and date: the window partitions hold at most all groups.
    """
    change = F.abs("revision_mw")
    per_date = Window.partitionBy("forecast_date").orderBy(
        F.col("absolute_revision_mw").desc(), "fuel_type"
    )
    return (
        _in_latest_pair(group_revisions)
        .filter(F.col("revision_mw") != 0)
        .withColumn("absolute_revision_mw", change)
        .withColumn("revision_rank", F.row_number().over(per_date))
    )


def unit_revision_ranking(changed_units: DataFrame) -> DataFrame:
    """Changed units of the latest pair ranked per target date, by size then name.

    A date may hold most of the fleet, so ranks come from a range partitioning.
    """
    return with_total_rank(
        changed_units,
        ["forecast_date"],
        [F.col("absolute_revision_mw").desc(), F.col("national_grid_bm_unit").asc()],
        "revision_rank",
    )


def top_ranked_units(changed_units: DataFrame, k: int) -> DataFrame:
    """The first ``k`` ranks per target date; each task keeps only ``k`` rows per date."""
    per_date = Window.partitionBy("forecast_date").orderBy(
        F.col("absolute_revision_mw").desc(), "national_grid_bm_unit"
    )
    return changed_units.withColumn("revision_rank", F.row_number().over(per_date)).filter(
        F.col("revision_rank") <= k
    )


def lowest_day(outlook: DataFrame) -> DataFrame:
    return (
        outlook.orderBy("total_available_mw", "forecast_date")
        .limit(1)
        .select(
            F.col("forecast_date").alias("lowest_availability_date"),
            F.col("total_available_mw").alias("lowest_availability_mw"),
        )
    )


def largest_system_revision(system_revision: DataFrame) -> DataFrame:
    return (
        system_revision.orderBy(F.abs("revision_mw").desc(), "forecast_date")
        .limit(1)
        .select(
            F.col("forecast_date").alias("largest_system_revision_date"),
            F.col("revision_mw").alias("largest_system_revision_mw"),
        )
    )


def revision_summary(changed_units: DataFrame) -> DataFrame:
    return changed_units.agg(
        F.count(F.lit(1)).alias("changed_unit_rows"),
        F.count_if(F.col("change_direction") == PAIR_UP).alias("upward_revision_rows"),
        F.count_if(F.col("change_direction") == PAIR_DOWN).alias("downward_revision_rows"),
        F.count_if("became_unavailable").alias("became_unavailable_rows"),
        F.count_if("returned_available").alias("returned_available_rows"),
    )


def pipeline_health(runs: DataFrame) -> DataFrame:
    """The latest run with its duration."""
    return (
        runs.orderBy(F.col("pipeline_run_id").desc())
        .limit(1)
        .withColumn(
            "duration_seconds", duration_seconds(F.col("started_at"), F.col("completed_at"))
        )
    )


def _one_row(df: DataFrame) -> Column:
    """A one-row product as a struct-valued scalar subquery, NULL if it has no row."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def dashboard_kpis(
    outlook: DataFrame, changed_units: DataFrame, system_revision: DataFrame, health: DataFrame
) -> DataFrame:
    """The one-row snapshot of all headline figures.

    It has no row at all if there is no lowest day, system revision or run.
    """
    abroad = "interconnector_available_mw"
    # Sum over count keeps more digits than AVG of a decimal does.
    mean_abroad = F.sum(abroad).cast("decimal(24,3)") / F.count(abroad).cast("decimal(12,0)")
    headline = outlook.agg(
        F.max("publish_time").alias("latest_publish_time"),
        F.min("forecast_date").alias("forecast_start_date"),
        F.max("forecast_date").alias("forecast_end_date"),
        F.min("total_available_mw").alias("minimum_total_available_mw"),
        F.max("total_available_mw").alias("maximum_total_available_mw"),
        F.min("gb_generation_storage_available_mw").alias("minimum_gb_generation_storage_mw"),
        F.round(mean_abroad, 2).alias("average_interconnector_available_mw"),
        # The lowest day in the same pass: smallest total, then earliest date.
        F.min(F.struct("total_available_mw", "forecast_date")).alias("_low"),
    )
    parts = headline.withColumns(
        {
            "_changes": _one_row(revision_summary(changed_units)),
            "_large": _one_row(largest_system_revision(system_revision)),
            "_run": _one_row(health),
        }
    ).filter("_low IS NOT NULL AND _large IS NOT NULL AND _run IS NOT NULL")
    return parts.select(
        "latest_publish_time",
        "forecast_start_date",
        "forecast_end_date",
        F.col("_low.forecast_date").alias("lowest_availability_date"),
        F.col("_low.total_available_mw").alias("lowest_availability_mw"),
        "minimum_total_available_mw",
        "maximum_total_available_mw",
        "minimum_gb_generation_storage_mw",
        "average_interconnector_available_mw",
        "_changes.*",
        "_large.largest_system_revision_date",
        "_large.largest_system_revision_mw",
        "_run.pipeline_run_id",
        F.col("_run.status").alias("pipeline_status"),
        F.round(F.col("_run.duration_seconds"), 3).alias("pipeline_duration_seconds"),
    )
