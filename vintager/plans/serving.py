"""Serving products over the history datasets.

Window products take rows already restricted to the trailing window: either
``trailing(table)`` over a stored revision table, or ``recent_entity_revisions`` /
``recent_series_revisions`` over canonical rows, which revise only what the window
touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintager.columns import (
    AVAILABLE,
    DEFAULT,
    DIRECTION,
    LATEST_TIME,
    REVISION,
    Columns,
)
from vintager.functions.labels import REMAINDER, with_labels
from vintager.functions.scalars import (
    UNCHANGED,
    UNKNOWN_GROUP,
    share_or_zero,
    stability_band,
    unit_name,
    watch_text,
    watch_tone,
)
from vintager.operators.publications import latest_publication, nearest_forecast, newest

METHODOLOGY = (
    "Analytical stability indicator computed from revisions between publications; "
    "not an official adequacy measure."
)


def _overall(name: str) -> Column:
    """The total over all rows; only used over aggregates of a few rows."""
    return F.sum(name).over(Window.partitionBy())


def kpis(system: DataFrame, by_group: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Latest publication, its total for the nearest date, publications and groups tracked."""
    return nearest_forecast(system, c).agg(
        newest(system, c.published).alias("latest_publication"),
        F.max(AVAILABLE).alias("system_available_mw"),
        system.agg(F.count_distinct(c.published)).scalar().alias("publications_loaded"),
        by_group.agg(F.count_distinct(c.group)).scalar().alias("fuel_types_tracked"),
    )


def system_profile(system: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """The latest publication's total by target date."""
    return (
        latest_publication(system, c)
        .groupBy(c.target)
        .agg(F.max(AVAILABLE).alias(AVAILABLE))
    )


def group_mix(
    by_group: DataFrame, dimension: DataFrame | None = None, c: Columns = DEFAULT
) -> DataFrame:
    """Availability by group at the nearest date, with label and share of the total.

    The total is a window over one row per group, so the rows are read once.
    """
    mix = (
        nearest_forecast(by_group, c)
        .groupBy(c.group)
        .agg(F.coalesce(F.sum(AVAILABLE), F.lit(0)).alias("available_mw"))
    )
    total = _overall("available_mw")
    shared = mix.withColumn("share_pct", share_or_zero(F.col("available_mw"), total, 1))
    return with_labels(shared, c.group, dimension, coded=True).select(
        F.col(c.group).alias("fuel_type"),
        "fuel_label",
        "short_label",
        "available_mw",
        "share_pct",
    )


def group_mix_top(mix: DataFrame, k: int = 7) -> DataFrame:
    """The ``k`` largest groups, and what remains of the total as one more category.

    The remainder appears only if it is positive. Shares are of the rows shown. Both
    windows see aggregates only: one row per group, then at most ``k + 1`` rows.
    """
    by_size = Window.orderBy(F.col("available_mw").desc(), "fuel_type")
    shown = F.col("_place") <= k
    code, full, short = REMAINDER
    rows = (
        mix.withColumn("_place", F.row_number().over(by_size))
        .groupBy(
            F.when(shown, F.col("fuel_type")).otherwise(code).alias("fuel_type"),
            F.when(shown, F.col("short_label")).otherwise(short).alias("short_label"),
            F.when(shown, F.col("fuel_label")).otherwise(full).alias("fuel_label"),
            shown.alias("_shown"),
        )
        .agg(F.sum("available_mw").alias("available_mw"))
        .filter(F.col("_shown") | (F.col("available_mw") > 0))
        .drop("_shown")
    )
    total = _overall("available_mw")
    return rows.withColumn("share_pct", share_or_zero(F.col("available_mw"), total, 2))


def group_revisions_net(
    windowed: DataFrame, dimension: DataFrame | None = None, c: Columns = DEFAULT
) -> DataFrame:
    """Net revision by group within the window, without groups that net to zero."""
    net = (
        windowed.groupBy(c.group)
        .agg(F.sum(REVISION).alias("net_revision_mw"))
        .filter(F.abs("net_revision_mw") > 0)
    )
    return with_labels(net, c.group, dimension, coded=True).select(
        F.col(c.group).alias("fuel_type"), "fuel_label", "net_revision_mw"
    )


def direction_counts(revisions: DataFrame) -> DataFrame:
    """Revisions by direction over all history, with shares of the three counts."""
    counts = revisions.groupBy(DIRECTION).agg(F.count(F.lit(1)).alias("count"))
    total = _overall("count")
    return counts.select(
        F.col(DIRECTION).alias("direction"),
        "count",
        share_or_zero(F.col("count"), total, 2).alias("share_pct"),
    )


def _movers(windowed: DataFrame, dimension: DataFrame | None, c: Columns) -> DataFrame:
    named = windowed.select(
        unit_name(F.col(c.entity), F.col(c.alias)).alias("unit"),
        F.coalesce(F.col(c.group), F.lit(UNKNOWN_GROUP)).alias("fuel_type"),
        F.col(DIRECTION).alias("direction"),
        F.col(REVISION).alias("revision_mw"),
        F.col(c.target).alias("forecast_date"),
        F.col(LATEST_TIME).alias("publication_time"),
    )
    return with_labels(named, "fuel_type", dimension).select(
        "unit",
        "fuel_type",
        "fuel_label",
        "direction",
        "revision_mw",
        "forecast_date",
        "publication_time",
    )


def top_revisions(
    windowed: DataFrame,
    limit: int = 10,
    dimension: DataFrame | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """The largest changes in the window; ties by newer publication, unit, target date."""
    ordered = (
        windowed.filter(F.col(REVISION) != 0)
        .orderBy(
            F.abs(REVISION).desc(),
            F.col(LATEST_TIME).desc(),
            unit_name(F.col(c.entity), F.col(c.alias)),
            c.target,
        )
        .limit(limit)
    )
    return _movers(ordered, dimension, c)


def largest_revision(
    windowed: DataFrame,
    upward: bool,
    dimension: DataFrame | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """The single largest upward (or downward) change in the window."""
    change = F.col(REVISION)
    moved = windowed.filter(change > 0 if upward else change < 0)
    return top_revisions(moved, 1, dimension, c).drop("direction")


def most_revised_group(
    windowed: DataFrame, dimension: DataFrame | None = None, c: Columns = DEFAULT
) -> DataFrame:
    """The group with the largest sum of absolute changes of its units in the window."""
    change = F.col(REVISION)
    top = (
        windowed.filter(change != 0)
        .groupBy(F.coalesce(F.col(c.group), F.lit(UNKNOWN_GROUP)).alias("fuel_type"))
        .agg(
            F.sum(F.abs(change)).alias("absolute_revision_mw"),
            F.sum(change).alias("net_revision_mw"),
            F.count(F.lit(1)).alias("revision_records"),
        )
        .orderBy(F.col("absolute_revision_mw").desc(), "fuel_type")
        .limit(1)
    )
    return with_labels(top, "fuel_type", dimension).select(
        "fuel_type", "fuel_label", "absolute_revision_mw", "net_revision_mw", "revision_records"
    )


def revision_signals(
    windowed: DataFrame, dimension: DataFrame | None = None, c: Columns = DEFAULT
) -> DataFrame:
    """One row: latest publication, largest changes up and down, most revised group.

    A signal that does not occur is NULL. All four come from one pass over the window:
    per group first, then over the groups. A largest change is the minimum of a struct
    that begins with the sort key.
    """
    change, published = F.col(REVISION), F.col(LATEST_TIME)
    unit = unit_name(F.col(c.entity), F.col(c.alias)).alias("unit")
    group = F.coalesce(F.col(c.group), F.lit(UNKNOWN_GROUP)).alias("fuel_type")

    def mover(key: Column) -> Column:
        newest_first = (-F.unix_micros(published)).alias("_newest")
        return F.struct(
            key.alias("_key"),
            newest_first,
            unit,
            F.col(c.target).alias("forecast_date"),
            group,
            change.alias("revision_mw"),
            published.alias("publication_time"),
        )

    by_group = windowed.groupBy(group).agg(
        F.max(published).alias("_latest"),
        F.min(F.when(change > 0, mover(-change))).alias("_up"),
        F.min(F.when(change < 0, mover(change))).alias("_down"),
        F.sum(F.abs(change)).alias("absolute_revision_mw"),
        F.sum(change).alias("net_revision_mw"),
        F.count_if(change != 0).alias("revision_records"),
    )
    most = F.struct(
        (-F.col("absolute_revision_mw")).alias("_key"),
        "fuel_type",
        "absolute_revision_mw",
        "net_revision_mw",
        "revision_records",
    )
    found = by_group.agg(
        F.max("_latest").alias("latest_publication"),
        F.min("_up").alias("_up"),
        F.min("_down").alias("_down"),
        F.min(F.when(F.col("revision_records") > 0, most)).alias("_most"),
    )

    def signal(rows: DataFrame, found_as: str, name: str, fields: list[str]) -> DataFrame:
        coded = rows.withColumn("_code", F.col(f"{found_as}.fuel_type"))
        labelled = with_labels(coded, "_code", dimension)
        parts = [
            F.col("fuel_label") if f == "fuel_label" else F.col(f"{found_as}.{f}") for f in fields
        ]
        present = F.when(F.col(found_as).isNotNull(), F.struct(*parts))
        return labelled.withColumn(name, present).drop("_code", "fuel_label", "short_label", found_as)

    moved = ["unit", "fuel_type", "fuel_label", "revision_mw", "forecast_date", "publication_time"]
    summed = [
        "fuel_type",
        "fuel_label",
        "absolute_revision_mw",
        "net_revision_mw",
        "revision_records",
    ]
    rows = signal(found, "_up", "largest_upward", moved)
    rows = signal(rows, "_down", "largest_downward", moved)
    return signal(rows, "_most", "most_revised_fuel", summed)


def stability(
    revisions: DataFrame,
    entity_window: DataFrame,
    group_window: DataFrame,
    dimension: DataFrame | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """One row: stability score and band over all history, watch status of the window.

    The score is the unchanged share, already rounded before it is banded. A history
    without any revision is an error.
    """
    counted = revisions.agg(
        F.count_if(F.col(DIRECTION) == UNCHANGED).alias("_same"), F.count(F.lit(1)).alias("_all")
    )
    return stability_of(counted, entity_window, group_window, dimension, c)


def stability_of(
    counted: DataFrame,
    entity_window: DataFrame,
    group_window: DataFrame,
    dimension: DataFrame | None = None,
    c: Columns = DEFAULT,
) -> DataFrame:
    """``stability`` from one row that counts unchanged (``_same``) and all (``_all``) revisions."""
    score = F.when(
        F.col("_all") == 0, F.raise_error("Revision history is empty.").cast("decimal(10,2)")
    ).otherwise(share_or_zero(F.col("_same"), F.col("_all"), 2).cast("decimal(10,2)"))
    net = F.coalesce(group_window.agg(F.sum(REVISION)).scalar(), F.lit(0))
    signals = revision_signals(entity_window, dimension, c)
    found = signals.select(F.struct("latest_publication", "most_revised_fuel")).scalar()
    return (
        counted.select(
            score.alias("stability_score"),
            net.alias("_net"),
            found.getField("most_revised_fuel").alias("_top"),
            found.getField("latest_publication").alias("latest_publication"),
        )
        .select(
            "stability_score",
            stability_band(F.col("stability_score")).alias("stability_band"),
            F.greatest(F.lit(0).cast("decimal(10,2)"), F.lit(100) - F.col("stability_score")).alias(
                "changed_revision_share_pct"
            ),
            F.round(F.col("_net").cast("decimal(28,3)"), 1).alias("net_revision_mw_24h"),
            watch_text(F.col("_net"), 0).alias("watch_status"),
            watch_tone(F.col("_net")).alias("watch_tone"),
            watch_text(F.col("_net"), 1).alias("watch_detail"),
            F.coalesce(F.col("_top.fuel_label"), F.lit("Unavailable")).alias("most_revised_fuel"),
            F.coalesce(
                F.col("_top.absolute_revision_mw").cast("decimal(28,3)"),
                F.lit(0).cast("decimal(28,3)"),
            ).alias("most_revised_fuel_abs_mw"),
            "latest_publication",
            F.lit(METHODOLOGY).alias("methodology"),
        )
    )
