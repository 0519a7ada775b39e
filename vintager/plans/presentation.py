"""Orderings for display. Operators return unordered rows; a total sort belongs here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintager.columns import ABS_REVISION, DEFAULT, LATEST_TIME, PREVIOUS_TIME, REVISION, Columns
from vintager.functions.scalars import DOWN, UNCHANGED, UP


def order_availability(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """By target date; groups of a date by falling availability, then name."""
    if c.group in df.columns:
        return df.orderBy(c.published, c.target, F.col("available_mw").desc(), c.group)
    return df.orderBy(c.published, c.target)


def order_pair_revisions(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Entity revisions by target date and falling size; groups by date and revision."""
    if c.entity in df.columns:
        keys = [c.target, F.col(ABS_REVISION).desc(), c.entity]
    elif c.group in df.columns:
        keys = [c.target, REVISION, c.group]
    else:
        keys = [c.target]
    return df.orderBy(PREVIOUS_TIME, LATEST_TIME, *keys)


def order_by_pair(df: DataFrame) -> DataFrame:
    return df.orderBy(PREVIOUS_TIME, LATEST_TIME)


def order_directions(df: DataFrame) -> DataFrame:
    """Up, down, unchanged."""
    places = F.when(F.col("direction") == UP, 0).when(F.col("direction") == DOWN, 1)
    return df.orderBy(places.when(F.col("direction") == UNCHANGED, 2))


def order_movements(df: DataFrame, value: str, name: str) -> DataFrame:
    """By falling absolute value, then name."""
    return df.orderBy(F.abs(value).desc(), name)
