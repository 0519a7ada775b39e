"""

All queries read the driver's ``events`` table, from which ``vintager.workload``
derives the publication history; whole tables, no subsets.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import oracles
from vintager import schema
from vintager import workload as w
from vintager.columns import DEFAULT as C
from vintager.columns import LATEST_TIME, PUBLISH_DATE
from vintager.functions.labels import fuel_dimension, with_labels
from vintager.functions.scalars import clipped_error, iso_timestamp, publication_stamp
from vintager.operators import pairs, publications, quality, revisions
from vintager.operators.availability import availability, group_history, system_history
from vintager.operators.neighbours import chunk_unit
from vintager.plans import audit, gold, jobs, relational, serving, state
from vintager.session import ensure_checkpoint_dir, shared_folder
from vintager.sources import landing, snapshots, store, tables, versions

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP_DIR = "/root/testdata/sf0.001"


def _plain(df: DataFrame) -> DataFrame:
    """Output types both engines share: no zoned timestamps, decimals, ints or structs."""
    columns = []
    for field in df.schema:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, T.StructType):
            columns += [
                column.getField(n).alias(f"{field.name}_{n}") for n in kind.fieldNames()
            ]
        else:
            columns.append(column)
    flat = df.select(*columns)
    casts = {T.TimestampType: "timestamp_ntz", T.DecimalType: "double", T.IntegerType: "bigint"}
    return flat.select(
        *[
            F.col(f"`{f.name}`").cast(casts[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in casts
            else F.col(f"`{f.name}`")
            for f in flat.schema
        ]
    )


def _on_history(build: Callable[[DataFrame], DataFrame]) -> Query:
    """A query over the canonical history."""
    return lambda spark, sf_dir: _plain(build(w.canonical(spark, sf_dir)))


def _groups(df: DataFrame) -> DataFrame:
    return group_history(df)


def _system(df: DataFrame) -> DataFrame:
    return system_history(group_history(df))


def _recent(df: DataFrame) -> DataFrame:
    return revisions.recent_entity_revisions(df)


def _recent_groups(df: DataFrame) -> DataFrame:
    chunk = chunk_unit(df, C.published)
    return revisions.recent_series_revisions(group_history(df), C.group_series, chunk=chunk)


def _stored(df: DataFrame) -> DataFrame:
    """A relation that several products read, written once to the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _pair(df: DataFrame) -> DataFrame:
    """The two newest publications compared."""
    return pairs.latest_pair_revisions(df)


def _gold_pair(df: DataFrame) -> DataFrame:
    """The newest adjacent pair that has revisions, of a history that ends with a publication
    that shares no target date with the one before it.
    """
    return pairs.newest_pair_revisions(w.with_disjoint_end(df))


def _units(unit: DataFrame) -> DataFrame:
    return gold.latest_changed_units(relational.unit_revisions(unit))


def _gold_units(df: DataFrame) -> DataFrame:
    return _units(_gold_pair(df))


def _totals(unit: DataFrame) -> DataFrame:
    return gold.latest_system_revision(relational.system_revisions(pairs.rollup_pair(unit)))


def _gold_system(df: DataFrame) -> DataFrame:
    return _totals(_gold_pair(df))


def _outlook(df: DataFrame) -> DataFrame:
    return gold.availability_outlook(relational.group_availability(availability(df, [C.group])))


def _health(df: DataFrame) -> DataFrame:
    return gold.pipeline_health(w.pipeline_runs(df))


def _dashboard(df: DataFrame) -> DataFrame:
    unit = _gold_pair(df)
    return gold.dashboard_kpis(_outlook(df), _units(unit), _totals(unit), _health(df))


def _reconciled_revisions(df: DataFrame) -> DataFrame:
    unit = _stored(pairs.all_pair_revisions(df))
    return quality.reconcile_revisions(
        unit, pairs.rollup_pair(unit, [C.group]), pairs.rollup_pair(unit)
    )


def _reconciled_availability(df: DataFrame) -> DataFrame:
    return quality.reconcile_availability(availability(df, [C.group]), availability(df))


def _labelled(df: DataFrame) -> DataFrame:
    """Group totals named by a dimension that lacks one code, which then names itself."""
    totals = df.groupBy(C.group).agg(F.sum(C.measure).alias("available_mw"))
    names = fuel_dimension(df.sparkSession).filter("code <> 'INTNED'")
    return with_labels(totals, C.group, names)


def _upsert_availability(df: DataFrame) -> DataFrame:
    target, source = w.upsert_sides(df)
    return tables.merged(target, source, [C.published, C.target, C.group])


def _upsert_system(df: DataFrame) -> DataFrame:
    """System availability, slightly off for all but the newest days, then put right from the
    twentieth on, through the stored table.
    """
    path = shared_folder(df.sparkSession, "upsert")
    rows = relational.system_availability(availability(df))
    time = F.col("publish_time")
    off = rows.filter(time < F.lit(w.STORED_BEFORE)).withColumn(
        "total_available_mw", (F.col("total_available_mw") + 1).cast("decimal(14,3)")
    )
    for part in (off, rows.filter(time >= F.lit("2024-01-20 00:00:00").cast("timestamp"))):
        tables.upsert(df.sparkSession, path, part, schema.SYSTEM_AVAILABILITY_KEY, "publish_time")
    return versions.read_version(df.sparkSession, path).drop(PUBLISH_DATE)


def _snapshots(df: DataFrame) -> DataFrame:
    """The history written as snapshot files of differing types and read as one."""
    folder = shared_folder(df.sparkSession, "snapshots")
    for i, part in enumerate(w.snapshot_kinds(df)):
        part.write.parquet(f"{folder}/kind{i}")
    return snapshots.canonical_history(df.sparkSession, f"{folder}/*", "*.parquet")


def _clipped(df: DataFrame) -> DataFrame:
    """Error messages far longer than the audit log keeps."""
    long = F.repeat("error_message", F.lit(200))
    return w.pipeline_runs(df).select("pipeline_run_id", clipped_error(long).alias("error_message"))


def _upsert_revisions(df: DataFrame) -> DataFrame:
    rows = relational.unit_revisions(pairs.all_pair_revisions(df))
    time = F.col("latest_publish_time")
    target = rows.filter(time < F.lit(w.STORED_BEFORE)).withColumn(
        "revision_mw", (F.col("revision_mw") + 1).cast("decimal(12,3)")
    )
    source = rows.filter(time >= F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return tables.merged(target, source, schema.UNIT_REVISION_KEY)


def _stamped(df: DataFrame) -> DataFrame:
    published = F.col(C.published)
    return publications.publications(df).select(
        published, publication_stamp(published).alias("stamp"), iso_timestamp(published).alias("iso")
    )


def _split(df: DataFrame) -> DataFrame:
    return landing.split_publications(df).withColumn(
        "publish_stamp", publication_stamp(F.col(C.published))
    )


def _mix(df: DataFrame) -> DataFrame:
    return serving.group_mix(_groups(df))


def _nearest(df: DataFrame) -> DataFrame:
    return publications.nearest_forecast(_system(df))


def _stability(df: DataFrame) -> DataFrame:
    unit = chunk_unit(df, C.published, series=C.entity_series)
    chunk = chunk_unit(df, C.published)
    return serving.stability(
        revisions.entity_revisions(df, chunk=unit),
        revisions.recent_entity_revisions(df, chunk=unit),
        revisions.recent_series_revisions(group_history(df), C.group_series, chunk=chunk),
    )


def _state(df: DataFrame) -> tuple[SparkSession, state.RevisionState]:
    """Stored revisions of the history, of which every ninth publication arrived late."""
    spark, late = df.sparkSession, w.publication_number(F.col(C.published)) % 9 == 4
    kept = state.RevisionState(shared_folder(spark, "state"))
    early = df.filter(~late)
    for history, new in ((early, early), (df, df.filter(late))):
        state.refresh(spark, kept, history, publications.publications(new))
    return spark, kept


def _stored_window(spark: SparkSession, kept: state.RevisionState) -> DataFrame:
    return state.recent(spark, kept.units)


def _stored_fuels(spark: SparkSession, kept: state.RevisionState) -> DataFrame:
    return serving.group_revisions_net(state.recent(spark, kept.groups))


def _upsert_null_times(df: DataFrame) -> DataFrame:
    """Availability whose time some rows lack, stored by two upserts of overlapping rows."""
    path = shared_folder(df.sparkSession, "upsert")
    rows = availability(df, [C.group]).withColumn(
        C.published, F.when(F.col(C.group) != "WIND", F.col(C.published))
    ).groupBy(C.published, C.target, C.group).agg(F.sum("available_mw").alias("available_mw"))
    early = rows.filter(F.day(C.target) <= 21)
    late = rows.filter(F.day(C.target) >= 11).withColumn("available_mw", F.col("available_mw") + 20)
    for part in (early, late):
        tables.upsert(df.sparkSession, path, part, [C.published, C.target, C.group], C.published)
    return versions.read_version(df.sparkSession, path).drop(PUBLISH_DATE)


def _backfill(df: DataFrame) -> DataFrame:
    """A range across the edge of the stored history: some publications are new."""
    rows = landing.publish_range(df, "2024-01-23T00:00:00Z", "2024-01-26T12:00:00+00:00")
    return jobs.backfill_summary(store.publication_status(rows, w.stored(df)))


def _outcome(df: DataFrame) -> DataFrame:
    """What one run over landing files does with each publication, some known before."""
    return store.ingest_outcome(w.landed(df), w.stored(df), w.quarantined(df))


def _queries() -> dict[str, Query]:
    h = _on_history
    return {
        # Sources
        "q_canonical_history": h(lambda df: df),
        "q_publication_calendar": h(publications.publication_calendar),
        "q_latest_publication": h(publications.latest_publication),
        "q_latest_two_publications": h(publications.latest_publications),
        "q_filter_fuels_units": h(
            lambda df: landing.select_listed(df, groups=["CCGT", "WIND", "INTFR"])
        ),
        "q_filter_units": h(
            lambda df: landing.select_listed(df, entities=["UNIT-3", "UNIT-17", "UNIT-40", "UNIT-x"])
        ),
        "q_mixed_snapshots": h(_snapshots),
        "q_publish_range": h(
            lambda df: landing.publish_range(df, "2024-01-10", "2024-01-12T13:00:00+01:00")
        ),
        "q_source_details": h(
            lambda df: quality.source_details(publications.latest_publication(df))
        ),
        "q_split_publications": h(_split),
        "q_publication_summary": h(landing.publication_summary),
        # Sinks, as the rows or reports they produce
        "q_new_publications": h(lambda df: store.new_rows(df, w.stored(df))),
        "q_ingest_outcome": h(_outcome),
        "q_publication_manifest": h(store.publication_manifest),
        "q_raw_load_status": h(lambda df: store.load_status(df, w.stored(df))),
        "q_upsert_fuel": h(_upsert_availability),
        "q_upsert_system": h(_upsert_system),
        "q_upsert_generic": h(_upsert_revisions),
        "q_upsert_null_times": h(_upsert_null_times),
        "q_verify_load": h(lambda df: tables.verify_load(df, w.stored(df), C.published)),
        # Data quality
        "q_duplicate_keys": h(lambda df: quality.duplicate_keys(w.duplicated(df))),
        "q_duplicate_rows": h(lambda df: quality.duplicate_summary(w.duplicated(df))),
        "q_quality_report": h(lambda df: quality.quality_report(w.duplicated(w.dirty(df)))),
        "q_ingest_report": h(lambda df: quality.ingest_report(w.duplicated(w.dirty(df)))),
        "q_null_counts": h(lambda df: quality.null_counts(w.dirty(df))),
        "q_negative_rows": h(lambda df: quality.negative_rows(w.dirty(df))),
        "q_reconcile_availability": h(_reconciled_availability),
        "q_reconcile_availability_dirty": h(lambda df: _reconciled_availability(w.dirty(df))),
        "q_differing_publications": h(lambda df: quality.differing_publications(df, w.drifted(df))),
        "q_differing_rows": h(lambda df: quality.differing_rows(df, w.drifted(df))),
        "q_reconcile_revisions": h(_reconciled_revisions),
        # Projections
        "q_raw_rename": h(relational.raw_rows),
        "q_coerce": h(
            lambda df: landing.parse_landing(w.as_text(df)).drop(C.collected)
        ),
        "q_publication_stamp": h(_stamped),
        "q_fuel_labels": h(_labelled),
        "q_fuel_type_changes": h(
            lambda df: revisions.group_changes(revisions.entity_revisions(df))
        ),
        # Filters
        "q_nearest_forecast": h(_nearest),
        "q_window_24h": h(_recent),
        # Availability
        "q_fuel_availability_history": h(_groups),
        "q_system_availability_history": h(_system),
        "q_fuel_availability": h(lambda df: availability(df, [C.group])),
        "q_system_availability": h(availability),
        "q_fuel_availability_dirty": h(lambda df: availability(w.dirty(df), [C.group])),
        # Revisions against the last appearance
        "q_unit_revision_history": h(revisions.entity_revisions),
        "q_fuel_revision_history": h(
            lambda df: revisions.series_revisions(
                _groups(df), C.group_series, chunk=chunk_unit(df, C.published)
            )
        ),
        "q_system_revision_history": h(
            lambda df: revisions.series_revisions(
                _system(df), C.total_series, chunk=chunk_unit(df, C.published)
            )
        ),
        "q_changed_rows_by_pair": h(
            lambda df: revisions.changed_rows_by_pair(revisions.entity_revisions(df))
        ),
        # Revisions against the adjacent publication
        "q_common_dates": h(
            lambda df: pairs.common_dates(
                w.stored(df), df.filter(F.col(C.published) >= F.lit(w.STORED_BEFORE))
            )
        ),
        "q_pair_overlap": h(pairs.pair_overlap),
        "q_unit_revisions_pair": h(_pair),
        "q_unit_revisions_all_pairs": h(pairs.all_pair_revisions),
        "q_unit_revisions_dirty": h(lambda df: pairs.all_pair_revisions(w.dirty(df))),
        "q_fuel_revisions_pair": h(
            lambda df: pairs.rollup_pair(pairs.all_pair_revisions(df), [C.group])
        ),
        "q_fuel_revisions_dirty": h(
            lambda df: pairs.rollup_pair(pairs.all_pair_revisions(w.dirty(df)), [C.group])
        ),
        "q_system_revisions_pair": h(lambda df: pairs.rollup_pair(pairs.all_pair_revisions(df))),
        "q_changed_rows_by_adjacent_pair": h(
            lambda df: pairs.changed_rows_by_adjacent_pair(pairs.all_pair_revisions(df))
        ),
        "q_top10_downward": h(lambda df: pairs.top_pair_movers(_pair(df), upward=False)),
        "q_top10_upward": h(lambda df: pairs.top_pair_movers(_pair(df), upward=True)),
        "q_latest_pair": h(
            lambda df: gold.latest_pair(
                relational.unit_revisions(pairs.all_pair_revisions(w.with_disjoint_end(df)))
            )
        ),
        # Gold
        "q_latest_availability_outlook": h(_outlook),
        "q_latest_availability_mix": h(lambda df: gold.availability_mix(_outlook(df))),
        "q_latest_system_revision": h(_gold_system),
        "q_latest_changed_units": h(_gold_units),
        "q_latest_fuel_revision_ranking": h(
            lambda df: gold.fuel_revision_ranking(
                relational.group_revisions(pairs.rollup_pair(_gold_pair(df), [C.group]))
            )
        ),
        "q_latest_unit_revision_ranking": h(
            lambda df: gold.unit_revision_ranking(_gold_units(df))
        ),
        "q_lowest_day": h(lambda df: gold.lowest_day(_outlook(df))),
        "q_largest_system_revision": h(lambda df: gold.largest_system_revision(_gold_system(df))),
        "q_revision_summary": h(lambda df: gold.revision_summary(_gold_units(df))),
        "q_pipeline_health": h(_health),
        "q_dashboard_kpis": h(_dashboard),
        # Serving
        "q_kpis": h(lambda df: serving.kpis(_system(df), _groups(df))),
        "q_system_profile": h(lambda df: serving.system_profile(_system(df))),
        "q_fuel_mix": h(_mix),
        "q_fuel_mix_fractional": h(lambda df: _mix(w.fractional(df))),
        "q_fuel_mix_top7": h(lambda df: serving.group_mix_top(_mix(df))),
        "q_fuel_revisions_24h": h(lambda df: serving.group_revisions_net(_recent_groups(df))),
        "q_direction_counts": h(
            lambda df: serving.direction_counts(revisions.entity_revisions(df))
        ),
        "q_top_unit_revisions": h(lambda df: serving.top_revisions(_recent(df))),
        "q_largest_upward": h(lambda df: serving.largest_revision(_recent(df), upward=True)),
        "q_largest_downward": h(lambda df: serving.largest_revision(_recent(df), upward=False)),
        "q_most_revised_fuel": h(lambda df: serving.most_revised_group(_recent(df))),
        "q_revision_signals": h(lambda df: serving.revision_signals(_recent(df))),
        "q_stability": h(_stability),
        # Serving from stored revisions
        "q_stored_stability": h(lambda df: state.stability(*_state(df))),
        "q_stored_direction_counts": h(lambda df: state.direction_counts(*_state(df))),
        "q_stored_window_24h": h(lambda df: _stored_window(*_state(df))),
        "q_stored_fuel_revisions_24h": h(lambda df: _stored_fuels(*_state(df))),
        # Jobs and audit
        "q_backfill_summary": h(_backfill),
        "q_history_report": h(lambda df: jobs.history_report(df)["row_counts"]),
        "q_clipped_errors": h(_clipped),
        "q_audit_state": h(lambda df: audit.audit_state(w.run_events(w.pipeline_runs(df)))),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the units whose availability moved most in the last 24 hours."""
    return queries()["q_top_unit_revisions"](spark, FLAGSHIP_DIR)


def _llm():
    """The queries of the subpackage for training data, if it is there."""
    try:
        import corpus_pipeline  # noqa: F401
        from vintager.llm import queries as llm
    except ImportError as error:
        if error.name not in ("corpus_pipeline", "vintager.llm"):
            raise
        return None
    return llm


def queries() -> dict[str, Query]:
    llm = _llm()
    return _queries() | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    llm = _llm()
    return oracles.all_sql() | (llm.oracle_sql() if llm else {})
