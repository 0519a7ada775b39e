"""Data-quality operators. Reports are DataFrames; only the verdicts raise."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintager.columns import (
    DEFAULT,
    LATEST_TIME,
    PREVIOUS_TIME,
    PUBLISH_DATE,
    REVISION,
    Columns,
)
from vintager.operators.sizing import broadcast_if_small


class QualityError(ValueError):
    """Raised when stored or incoming rows break a fatal rule."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [name for name in required if name not in present]


def require_columns(df: DataFrame, c: Columns = DEFAULT) -> None:
    missing = missing_columns(df, c.required)
    if missing:
        raise QualityError("Missing columns: " + ", ".join(sorted(missing)))


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise QualityError("The publication has no rows.")


def _null(name: str) -> Column:
    return F.count_if(F.col(name).isNull())


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def duplicate_keys(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """The source keys that occur more than once, with their row counts."""
    return df.groupBy(*c.key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def duplicate_summary(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Duplicated keys, and rows involved in them, as one row."""
    return duplicate_keys(df, c).agg(
        F.count(F.lit(1)).alias("duplicate_source_keys"),
        _total("rows").alias("duplicate_key_rows"),
    )


def quality_report(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """All whole-history metrics in one row, from one scan and one key shuffle.

    Grouping by the source key first lets duplicates, NULL keys and row counts come
    from the same pass; copies of one key collapse before the shuffle.
    """
    by_key = df.groupBy(*c.key).agg(
        F.count(F.lit(1)).alias("_n"), _null(c.measure).alias("_null_measure")
    )

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    return by_key.agg(
        _total("_n").alias("rows"),
        (
            F.count_distinct(c.published)
            + F.max(F.when(F.col(c.published).isNull(), 1).otherwise(0))
        ).alias("publications"),
        F.count_if(F.col("_n") > 1).alias("duplicate_source_keys"),
        rows_where(F.col(c.entity).isNull()).alias("null_national_grid_bm_units"),
        rows_where(F.col(c.published).isNull()).alias("null_publish_times"),
        rows_where(F.col(c.target).isNull()).alias("null_forecast_dates"),
        _total("_null_measure").alias("null_output_usable"),
    ).withColumn("publications", F.coalesce("publications", F.lit(0)))


def assert_quality(df: DataFrame, c: Columns = DEFAULT) -> dict[str, int]:
    """The verdict on a whole history: its metrics, or an error naming the failed ones."""
    require_columns(df, c)
    report = quality_report(df, c).first().asDict()
    failed = {k: v for k, v in report.items() if k not in ("rows", "publications") and v}
    if failed:
        raise QualityError(f"Quality checks failed: {failed}")
    return report


def null_counts(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """NULLs of every required column, one row."""
    return df.agg(*[_null(name).alias(f"null_{name}") for name in c.required])


def negative_rows(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Rows with a negative measure; values that are not numbers do not count."""
    negative = F.col(c.measure).try_cast("double") < 0
    return df.agg(F.count_if(negative).alias("negative_output_usable_rows"))


def ingest_report(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Per publication: rows, NULL counts, rows in duplicated keys, negative measures.

    Only duplicated keys are fatal at ingest; the rest is reported.
    """
    negative = F.col(c.measure).try_cast("double") < 0
    nullable = [name for name in c.required if name not in c.key]
    by_key = df.groupBy(*c.key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(negative).alias("_negative"),
        *[_null(name).alias(f"_null_{name}") for name in nullable],
    )

    def nulls(name: str) -> Column:
        if name in nullable:
            return _total(f"_null_{name}").alias(f"null_{name}")
        rows = F.sum(F.when(F.col(name).isNull(), F.col("_n")))
        return F.coalesce(rows, F.lit(0)).alias(f"null_{name}")

    duplicated = F.sum(F.when(F.col("_n") > 1, F.col("_n")))
    return by_key.groupBy(c.published).agg(
        _total("_n").alias("row_count"),
        F.coalesce(duplicated, F.lit(0)).alias("duplicate_key_rows"),
        _total("_negative").alias("negative_output_usable_rows"),
        *[nulls(name) for name in c.required if name != c.published],
    )


def assert_ingest(df: DataFrame, c: Columns = DEFAULT) -> dict[str, int]:
    """The verdict on incoming rows: not empty, complete columns, no duplicated key."""
    missing = missing_columns(df, c.required)
    if missing:
        raise QualityError(f"Missing columns: {missing}")
    report = ingest_report(df, c)
    unpublished = F.sum(F.when(F.col(c.published).isNull(), F.col("row_count")))
    metrics = (
        report.agg(
            *[_total(name).alias(name) for name in report.columns if name != c.published],
            F.coalesce(unpublished, F.lit(0)).alias(f"null_{c.published}"),
        )
        .first()
        .asDict()
    )
    if metrics["row_count"] == 0:
        raise QualityError("The publication has no rows.")
    if metrics["duplicate_key_rows"]:
        raise QualityError(f"{metrics['duplicate_key_rows']} rows share a source key.")
    return metrics


def source_details(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Publication time, row count and number of publications of ``df``."""
    return df.agg(
        F.max(c.published).alias(c.published),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(c.published).alias("publications"),
    )


def single_publication_time(df: DataFrame, c: Columns = DEFAULT) -> datetime:
    """The one publication time of ``df`` (UTC), or an error."""
    details = source_details(df, c).select(
        F.unix_micros(c.published).alias("micros"), "publications"
    ).first()
    if details["publications"] != 1:
        raise QualityError(
            f"Expected exactly one publication time, found {details['publications']}."
        )
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=details["micros"])


def reconcile_availability(by_group: DataFrame, system: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Publications and dates whose group totals differ from the system totals."""
    keys = [c.published, c.target]
    rolled = by_group.groupBy(*keys).agg(
        F.sum("available_mw").alias("group_mw"),
        F.sum("zero_availability_units").alias("group_zero_units"),
    )
    both = rolled.join(system, keys, "full_outer")
    same = F.col("group_mw").eqNullSafe(F.col("total_available_mw")) & F.col(
        "group_zero_units"
    ).eqNullSafe(F.col("zero_availability_units"))
    return both.filter(~same).select(
        *keys, "group_mw", "total_available_mw", "group_zero_units", "zero_availability_units"
    )


def reconcile_revisions(
    entity: DataFrame, by_group: DataFrame, system: DataFrame
) -> DataFrame:
    """Sum of revisions per pair at the entity, group and system level, side by side."""
    pair = [PREVIOUS_TIME, LATEST_TIME]

    def level(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*pair).agg(F.sum(REVISION).alias(name))

    return (
        level(entity, "unitRevisionMW")
        .join(level(by_group, "fuelRevisionMW"), pair, "full_outer")
        .join(level(system, "systemRevisionMW"), pair, "full_outer")
    )



def publication_digests(df: DataFrame, columns: list[str], c: Columns = DEFAULT) -> DataFrame:
    """Rows, and two order-free digests of the bag of rows, per publication.

    Each row is hashed twice, and hashes are added and xor-ed, so one aggregation with
    map-side combine stands for all rows of a publication, however many they are. NULLs and
    empty texts are told apart, and a row that is there twice counts twice.
    """
    # Hashes skip NULLs, so which columns are NULL goes in first.
    nulls = F.concat(*[F.when(F.col(name).isNull(), "1").otherwise("0") for name in columns])
    first, second = F.xxhash64(nulls, *columns), F.xxhash64(F.lit(1), nulls, *columns[::-1])
    return df.groupBy(c.published).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(first.cast("decimal(20,0)")).alias("hash_sum"),
        F.sum(second.cast("decimal(20,0)")).alias("second_sum"),
        F.bit_xor(first).alias("hash_xor"),
    )


def differing_publications(
    left: DataFrame, right: DataFrame, columns: list[str] | None = None, c: Columns = DEFAULT
) -> DataFrame:
    """Publications whose bags of rows differ, with the rows of either side (0 if it lacks one).

    One row per publication and side meets here, so tables of any size that are equal are
    proven so without joining their rows.
    """
    names = columns or [name for name in left.columns if name != PUBLISH_DATE]
    renamed = {"rows": "right_rows", "hash_sum": "_sum", "second_sum": "_second", "hash_xor": "_xor"}
    other = publication_digests(right, names, c).withColumnsRenamed(
        renamed | {c.published: "_published"}
    )
    both = publication_digests(left, names, c).join(
        other, F.col(c.published).eqNullSafe(F.col("_published")), "full_outer"
    )
    same = (
        F.col("rows").eqNullSafe(F.col("right_rows"))
        & F.col("hash_sum").eqNullSafe(F.col("_sum"))
        & F.col("second_sum").eqNullSafe(F.col("_second"))
        & F.col("hash_xor").eqNullSafe(F.col("_xor"))
    )
    return both.filter(~same).select(
        F.coalesce(c.published, "_published").alias(c.published),
        F.coalesce("rows", F.lit(0)).alias("left_rows"),
        F.coalesce("right_rows", F.lit(0)).alias("right_rows"),
    )


def differing_rows(
    left: DataFrame, right: DataFrame, columns: list[str] | None = None, c: Columns = DEFAULT
) -> DataFrame:
    """The rows that only one side has, or has more often: the row, left_copies, right_copies.

    Only publications whose digests differ are compared row by row, by one aggregation of
    both sides.
    """
    names = columns or [name for name in left.columns if name != PUBLISH_DATE]
    unequal = differing_publications(left, right, names, c).select(
        F.col(c.published).alias("_published")
    )
    listed = broadcast_if_small(unequal)
    sides = left.select(*names, F.lit(1).alias("_side")).unionByName(
        right.select(*names, F.lit(-1).alias("_side"))
    )
    open_ = sides.join(listed, F.col(c.published).eqNullSafe(F.col("_published")), "left_semi")
    return (
        open_.groupBy(*names)
        .agg(
            F.count_if(F.col("_side") > 0).alias("left_copies"),
            F.count_if(F.col("_side") < 0).alias("right_copies"),
        )
        .filter(F.col("left_copies") != F.col("right_copies"))
    )
