"""Run audit: an append-only event log, and the state of each run derived from it.

Events are never updated, so starting, completing and failing are appends that no
concurrent writer can lose; the current row of a run is an aggregation of its events.
"""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vintager.functions.scalars import clipped_error

RUNNING, SUCCEEDED, FAILED = "RUNNING", "SUCCEEDED", "FAILED"
EVENT_SCHEMA = (
    "pipeline_run_id bigint, pipeline_name string, source_dataset string, "
    "source_publish_time timestamp, event_time timestamp, rows_processed bigint, "
    "status string, error_message string"
)


def _append(spark: SparkSession, log: str, **values: object) -> None:
    kinds = [part.strip().split(" ") for part in EVENT_SCHEMA.split(",")]
    columns = [
        F.current_timestamp().alias(name)
        if name == "event_time"
        else F.lit(values.get(name)).cast(kind).alias(name)
        for name, kind in kinds
    ]
    event = spark.range(1).select(*columns)
    event.withColumn("error_message", clipped_error(F.col("error_message"))).write.mode(
        "append"
    ).parquet(log)


def audit_start(spark: SparkSession, log: str, name: str, dataset: str) -> int:
    """Record a RUNNING run and return its id; ids grow with time."""
    run_id = time.time_ns() // 1000
    _append(
        spark, log, pipeline_run_id=run_id, pipeline_name=name, source_dataset=dataset, status=RUNNING
    )
    return run_id


def audit_complete(
    spark: SparkSession, log: str, run_id: int, publish_time: datetime | None, rows: int
) -> None:
    _append(
        spark,
        log,
        pipeline_run_id=run_id,
        source_publish_time=publish_time,
        rows_processed=rows,
        status=SUCCEEDED,
    )


def audit_fail(
    spark: SparkSession,
    log: str,
    run_id: int,
    error: str,
    publish_time: datetime | None = None,
) -> None:
    """Record a failure; an absent publication time keeps the one known before."""
    _append(
        spark,
        log,
        pipeline_run_id=run_id,
        source_publish_time=publish_time,
        status=FAILED,
        error_message=error,
    )


def audit_state(events: DataFrame) -> DataFrame:
    """The current row of each run, from its events in order of time."""
    at = F.col("event_time")
    ended = F.col("status") != RUNNING
    # Among events of one instant the end of a run follows its start.
    order = F.struct(at, ended.cast("int"))

    def last(name: str) -> Column:
        return F.max_by(name, order).alias(name)

    def last_known(name: str) -> Column:
        known = F.when(F.col(name).isNotNull(), order)
        return F.max_by(name, known).alias(name)

    return events.groupBy("pipeline_run_id").agg(
        last_known("pipeline_name"),
        last_known("source_dataset"),
        last_known("source_publish_time"),
        F.min(F.when(~ended, at)).alias("started_at"),
        F.max(F.when(ended, at)).alias("completed_at"),
        last_known("rows_processed"),
        last("status"),
        last("error_message"),
    )
