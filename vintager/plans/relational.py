"""Analytical frames in their relational names, order and types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintager import schema
from vintager.functions.scalars import nan_to_null


def to_relational(df: DataFrame, layout: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Select, rename and cast by a ``schema`` layout; NaN becomes NULL."""

    kinds = {field.name: field.dataType for field in df.schema}

    def column(source: str, name: str, kind: str) -> Column:
        value = F.col(source)
        if isinstance(kinds[source], (T.DoubleType, T.FloatType)):
            value = nan_to_null(value)
        return value.cast(kind).alias(name)

    return df.select(*[column(*entry) for entry in layout])


def raw_rows(df: DataFrame) -> DataFrame:
    return to_relational(df, schema.RAW_TABLE)


def group_availability(df: DataFrame) -> DataFrame:
    return to_relational(df, schema.GROUP_AVAILABILITY_TABLE)


def system_availability(df: DataFrame) -> DataFrame:
    return to_relational(df, schema.SYSTEM_AVAILABILITY_TABLE)


def unit_revisions(df: DataFrame) -> DataFrame:
    return to_relational(df, schema.UNIT_REVISION_TABLE)


def group_revisions(df: DataFrame) -> DataFrame:
    return to_relational(df, schema.GROUP_REVISION_TABLE)


def system_revisions(df: DataFrame) -> DataFrame:
    return to_relational(df, schema.SYSTEM_REVISION_TABLE)
