"""Test workload: canonical publications derived from an event table.

``events`` (event_id, user_id, value, ts) becomes a publication history: a user is a
unit, every twelve hours are one publication, and the events of a cell collapse to
the last one, so the source key is unique. Series have gaps, adjacent publications
share some target dates, and zeros, unchanged values and ties are common.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintager.columns import DEFAULT as C
from vintager.operators.availability import availability
from vintager.operators.publications import NUMBER, publication_calendar
from vintager.session import use_utc
from vintager.sources.landing import FILE, FILE_TIME

STORED_BEFORE = datetime(2024, 1, 25, tzinfo=timezone.utc)
GROUP_CHANGE_AT = datetime(2024, 1, 16, tzinfo=timezone.utc)
GROUPS = ["CCGT", "OCGT", "NUCLEAR", "WIND", "BIOMASS", "PS", "INTFR", "INTNED"]


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", ts)
    published = F.when(F.hour(ts) >= 12, day + F.expr("INTERVAL 12 HOURS")).otherwise(day)
    block = F.floor((F.day(published) - 1) / 5)
    ahead = (5 * (block + 1) + 5 * (F.col("event_id") % 2)).cast("int")
    cells = (
        events.select(
            "user_id",
            "event_id",
            "value",
            ts.alias("ts"),
            published.alias("published"),
            F.date_add(F.lit("2024-01-01").cast("date"), ahead).alias("target"),
        )
        .groupBy("user_id", "published", "target")
        .agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("collected"))
    )
    user = F.col("user_id")
    group = F.when(
        (user % 50 == 7) & (F.col("published") >= F.lit(GROUP_CHANGE_AT)), "OTHER"
    ).otherwise(F.element_at(F.array(*[F.lit(g) for g in GROUPS]), (user % 8 + 1).cast("int")))
    return cells.select(
        F.lit("SYNTH").alias(C.dataset),
        group.alias(C.group),
        F.concat(F.lit("UNIT-"), user.cast("string")).alias(C.entity),
        F.when(user % 3 != 0, F.concat(F.lit("T_UNIT-"), user.cast("string"))).alias(C.alias),
        F.col("published").alias(C.published),
        F.col("target").alias(C.target),
        (F.floor(F.col("value") / 20) * 20).cast("bigint").alias(C.measure),
        F.col("collected").alias(C.collected),
    )


def with_disjoint_end(df: DataFrame) -> DataFrame:
    """The history and one more publication, whose target dates no other publication has.

    It repeats the newest publication half a day later and 400 days further ahead.
    """
    last = df.filter(F.col(C.published) == df.agg(F.max(C.published)).scalar())
    end = last.withColumns(
        {
            C.published: F.col(C.published) + F.expr("INTERVAL 12 HOURS"),
            C.target: F.date_add(F.col(C.target), 400),
        }
    )
    return df.unionByName(end)


def unit_number() -> Column:
    return F.substring_index(F.col(C.entity), "-", -1).cast("int")


def stored(df: DataFrame) -> DataFrame:
    return df.filter(F.col(C.published) < F.lit(STORED_BEFORE))


def drifted(df: DataFrame) -> DataFrame:
    """The history as another table might hold it: a value off, rows missing, twice or added."""
    n, p = unit_number(), publication_number(F.col(C.published))
    copies = F.when((p == 9) & (n % 19 == 3), 0).when((p == 17) & (n % 23 == 5), 2).otherwise(1)
    rows = df.withColumn(
        C.alias, F.when((p == 31) & (n % 12 == 6), F.lit("")).otherwise(F.col(C.alias))
    ).withColumn(
        C.measure, F.when((p == 25) & (n % 29 == 7), F.col(C.measure) + 1).otherwise(F.col(C.measure))
    )
    return rows.select("*", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("_")).drop("_")


def duplicated(df: DataFrame) -> DataFrame:
    return df.unionByName(df.filter(unit_number() % 10 == 0))


def dirty(df: DataFrame) -> DataFrame:
    n, mw = unit_number(), F.col(C.measure)
    return df.withColumns(
        {
            C.measure: F.when(n % 11 == 2, None)
            .when((mw == 0) & (n % 7 == 1), F.lit(-20).cast("bigint"))
            .otherwise(mw),
            C.group: F.when(n % 13 != 3, F.col(C.group)),
        }
    )


def fractional(df: DataFrame) -> DataFrame:
    """Measures in eighths of a megawatt, so that sums, shares and their ties are not whole."""
    eighths = F.col(C.measure) * 1000 + 125 * (unit_number() % 8)
    return df.withColumn(C.measure, (eighths.cast("decimal(18,0)") / 1000).cast("decimal(12,3)"))


def snapshot_kinds(df: DataFrame) -> list[DataFrame]:
    """The history in three parts whose columns have other types: whole and floating numbers,
    and text, some of it no number or date.
    """
    n, p = unit_number(), publication_number(F.col(C.published)) % 3
    measure, target = F.col(C.measure), F.col(C.target)
    text = {
        C.measure: F.when(n % 11 == 0, "bad").otherwise(measure.cast("string")),
        C.target: F.when(n % 17 == 0, "n/a").otherwise(F.date_format(target, "yyyy-MM-dd")),
        C.published: F.date_format(C.published, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    }
    floating = F.when(n % 13 == 1, F.lit(float("nan"))).otherwise(measure.cast("double") + 0.125)
    return [
        df.filter(p == 0),
        df.filter(p == 1).withColumn(C.measure, floating),
        df.filter(p == 2).withColumns(text),
    ]


def as_text(df: DataFrame) -> DataFrame:
    n = unit_number()
    return df.select(
        C.dataset,
        C.group,
        C.entity,
        C.alias,
        F.date_format(C.published, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(C.published),
        F.when(n % 17 == 0, "n/a")
        .otherwise(F.date_format(C.target, "yyyy-MM-dd"))
        .alias(C.target),
        F.when(n % 11 == 0, "bad").otherwise(F.col(C.measure).cast("string")).alias(C.measure),
    )


def publication_number(column: Column) -> Column:
    """1 for the first half of the month's first day, 2 for its second half, and so on."""
    return 2 * F.day(column) - 1 + (F.hour(column) >= 12).cast("int")


def landed(df: DataFrame) -> DataFrame:
    """The history as rows of landing files: whole, split, pulled twice, with repeated keys,
    and some without a publication time.
    """
    n, p = unit_number(), publication_number(F.col(C.published))
    copies = (
        F.when((p % 7 == 3) & (n % 10 == 0), F.array(F.lit("a"), F.lit("a")))
        .when(p % 5 == 2, F.array(F.lit("a"), F.lit("b")))
        .when((p % 5 == 1) & (n % 2 == 1), F.array(F.lit("b")))
        .otherwise(F.array(F.lit("a")))
    )
    file = F.col(FILE)
    return df.select("*", F.explode(copies).alias(FILE)).withColumns(
        {
            C.measure: F.col(C.measure) + F.when(file == "b", 20).otherwise(0),
            C.published: F.when((p % 7 != 5) | (n % 97 != 5), F.col(C.published)),
            FILE_TIME: F.when(file == "a", F.lit(datetime(2024, 2, 1, tzinfo=timezone.utc)))
            .otherwise(F.lit(datetime(2024, 2, 2, tzinfo=timezone.utc))),
        }
    )


def quarantined(df: DataFrame) -> DataFrame:
    """The later publications that an earlier run refused."""
    p = publication_number(F.col(C.published))
    return df.filter((F.col(C.published) >= F.lit(STORED_BEFORE)) & (p % 11 == 4))


def pipeline_runs(df: DataFrame) -> DataFrame:
    """One audited run per publication, numbered in order; every seventh one failed."""
    numbers = publication_calendar(df).select(C.published, F.col(NUMBER).alias("id"))
    per_publication = df.groupBy(C.published).agg(
        F.max(C.collected).alias("completed_at"), F.count(F.lit(1)).alias("n")
    )
    failed = F.col("id") % 7 == 0
    return per_publication.join(numbers, C.published).select(
        F.col("id").alias("pipeline_run_id"),
        F.lit("publication_run").alias("pipeline_name"),
        F.lit("SYNTH").alias("source_dataset"),
        F.col(C.published).alias("source_publish_time"),
        F.when(~failed, F.col("n")).alias("rows_processed"),
        F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("status"),
        F.col(C.published).alias("started_at"),
        "completed_at",
        F.when(failed, F.concat(F.lit("Stage 'load' failed: run "), F.col("id").cast("string"))).alias(
            "error_message"
        ),
    )


def run_events(runs: DataFrame) -> DataFrame:
    """The audit events of those runs: a start and an end each, from one pass."""
    start = F.struct(
        F.lit(None).cast("timestamp").alias("publish_time"),
        F.col("started_at").alias("event_time"),
        F.lit(None).cast("bigint").alias("rows"),
        F.lit("RUNNING").alias("state"),
        F.lit(None).cast("string").alias("error"),
    )
    end = F.struct(
        F.col("source_publish_time").alias("publish_time"),
        F.col("completed_at").alias("event_time"),
        F.col("rows_processed").alias("rows"),
        F.col("status").alias("state"),
        F.col("error_message").alias("error"),
    )
    return runs.select(
        "pipeline_run_id", "pipeline_name", "source_dataset", F.inline(F.array(start, end))
    ).select(
        "pipeline_run_id",
        F.when(F.col("state") == "RUNNING", F.col("pipeline_name")).alias("pipeline_name"),
        F.when(F.col("state") == "RUNNING", F.col("source_dataset")).alias("source_dataset"),
        F.col("publish_time").alias("source_publish_time"),
        "event_time",
        F.col("rows").alias("rows_processed"),
        F.col("state").alias("status"),
        F.col("error").alias("error_message"),
    )


def upsert_sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored availability table, slightly off, and the newer rows to upsert into it."""
    by_group = availability(df, [C.group])
    target = by_group.filter(F.col(C.published) < F.lit(STORED_BEFORE)).withColumn(
        "available_mw", F.col("available_mw") + 1
    )
    source = by_group.filter(
        F.col(C.published) >= F.lit(datetime(2024, 1, 20, tzinfo=timezone.utc))
    )
    return target, source
