"""Availability totals per publication and target date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.columns import AVAILABLE, DEFAULT, Columns


def group_history(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Sum of the measure by publication, target date and group."""
    return df.groupBy(c.published, c.target, c.group).agg(F.sum(c.measure).alias(AVAILABLE))


def system_history(history: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Sum by publication and target date, rolled up from the group history.

    Sums are additive, so the raw rows are not read again.
    """
    return history.groupBy(c.published, c.target).agg(F.sum(AVAILABLE).alias(AVAILABLE))


def availability(
    df: DataFrame,
    groups: Sequence[str] = (),
    c: Columns = DEFAULT,
    total: str | None = None,
) -> DataFrame:
    """Sum, distinct entities and zero count by publication, target date and groups.

    Rows with a NULL grouping key are left out, and a group of unknown measures
    sums to 0. Distinct counts do not add up over groups, so the system level is
    computed from the rows, not from the group level.
    """
    keys = [c.published, c.target, *groups]
    keyed = df
    for key in keys:
        keyed = keyed.filter(F.col(key).isNotNull())
    name = total or ("available_mw" if groups else "total_available_mw")
    return keyed.groupBy(*keys).agg(
        F.coalesce(F.sum(c.measure), F.lit(0)).alias(name),
        F.count_distinct(c.entity).alias("bm_units"),
        F.count_if(F.col(c.measure) == 0).alias("zero_availability_units"),
    )
