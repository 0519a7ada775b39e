"""Incremental ingest and incremental revisions with Structured Streaming.

Both work per micro-batch through ``foreachBatch`` with idempotent writes, so a batch
that is replayed after a failure leaves the same tables.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vintager.columns import DEFAULT, LATEST_TIME, PREVIOUS_TIME, PUBLISH_DATE, Columns
from vintager.operators.revisions import entity_revisions
from vintager.operators.sizing import broadcast_if_small
from vintager.schema import LANDING
from vintager.sources.landing import parse_landing, with_file
from vintager.sources.store import admit, manifest_path, read_store
from vintager.sources.tables import path_exists, remove_path, upsert


def landing_stream(
    spark: SparkSession,
    landing: str,
    c: Columns = DEFAULT,
    files_per_batch: int = 1000,
    arrays: bool = True,
) -> DataFrame:
    """New JSON files of the landing folder as canonical rows."""
    raw = (
        spark.readStream.schema(LANDING)
        .option("multiLine", arrays)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    )
    return parse_landing(with_file(raw), c)


def run_available(
    rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process everything that has arrived since the last run, then stop."""
    query = (
        rows.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_stream(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    c: Columns = DEFAULT,
    revisions: str | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Store each publication once; with ``revisions``, keep that table up to date too.

    Batches only stage their parsed rows, beside ``checkpoint`` and by batch, so a replay
    overwrites its own. Publications are admitted once the run's last batch is staged, from
    all staged rows: a publication in several files is whole, however the files fall into
    batches. One that is refused goes to the store's quarantine and stops nothing. What is
    staged is removed last, so a run that dies in between is finished by the next one.
    """
    staged = f"{checkpoint}-staged"

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staged}/batch={batch_id}")

    query = run_available(landing_stream(spark, landing, c, files_per_batch), handle, checkpoint)
    if path_exists(spark, staged):
        rows = spark.read.parquet(staged).drop("batch")
        if not rows.isEmpty():
            admit(rows, store, c)
            if revisions is not None and path_exists(spark, manifest_path(store)):
                times = rows.select(c.published).filter(F.col(c.published).isNotNull())
                refresh_revisions(spark, store, times.distinct(), revisions, c)
        remove_path(spark, staged)
    return query


def touched_dates(
    history: DataFrame, times: DataFrame, c: Columns = DEFAULT
) -> tuple[Column, Column]:
    """Scalar bounds of the target dates that publications ``times`` mention."""
    dates = _rows_of(history, times, c).agg(
        F.struct(F.min(c.target).alias("low"), F.max(c.target).alias("high"))
    ).scalar()
    return dates.getField("low"), dates.getField("high")


def _rows_of(history: DataFrame, times: DataFrame, c: Columns) -> DataFrame:
    """The rows of publications ``times``; of a stored history only their days are read."""
    fresh = history.join(broadcast_if_small(times), c.published, "left_semi")
    if PUBLISH_DATE not in history.columns:
        return fresh
    days = times.agg(
        F.struct(
            F.min(F.to_date(c.published)).alias("low"), F.max(F.to_date(c.published)).alias("high")
        )
    ).scalar()
    return fresh.filter(F.col(PUBLISH_DATE).between(days.getField("low"), days.getField("high")))


def affected_revisions(history: DataFrame, times: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Revisions that publications ``times`` add or change, from the whole history.

    A publication that arrives late also becomes the predecessor of rows already
    stored. Its series are revised as a whole, and the revisions on either side of it
    are returned. Only target dates that the new publications mention are read.
    """
    series = _rows_of(history, times, c).select(*c.entity_series).distinct()
    low, high = touched_dates(history, times, c)
    # Series with a NULL unit or date are matched like any other, as in a batch.
    listed = series.withColumnsRenamed({k: f"_of_{k}" for k in c.entity_series})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in c.entity_series])
    touched = history.filter(
        F.col(c.target).isNull()
        | F.col(c.target).between(low, high)
    ).join(listed, same, "left_semi")
    revised = entity_revisions(touched.select(*c.required), c)
    for name, flag in ((LATEST_TIME, "_is_new"), (PREVIOUS_TIME, "_follows_new")):
        listed = times.select(F.col(c.published).alias(name), F.lit(True).alias(flag))
        revised = revised.join(broadcast_if_small(listed), name, "left")
    return revised.filter("_is_new OR _follows_new").drop("_is_new", "_follows_new")


def refresh_revisions(
    spark: SparkSession, store: str, times: DataFrame, path: str, c: Columns = DEFAULT
) -> int:
    """Bring the stored revision table up to date with publications ``times``.

    The rows come from the store, which keeps the first version of a publication, so
    a replayed or repeated publication changes nothing.
    """
    rows = affected_revisions(read_store(spark, store), times, c)
    return upsert(spark, path, rows, [*c.entity_series, LATEST_TIME], LATEST_TIME)
