"""Jobs: named sequences of operators, sinks and audit events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vintager import schema
from vintager.columns import DEFAULT, LATEST_TIME, PREVIOUS_TIME, PUBLISH_DATE, Columns
from vintager.operators.availability import availability, group_history, system_history
from vintager.operators.neighbours import chunk_unit
from vintager.operators.pairs import (
    all_pair_revisions,
    changed_rows_by_adjacent_pair,
    pair_revisions,
    rollup_pair,
    top_pair_movers,
)
from vintager.operators.publications import latest_publication, latest_publications, require_publications
from vintager.operators.quality import (
    QualityError,
    assert_quality,
    ingest_report,
    require_rows,
    source_details,
)
from vintager.operators.revisions import changed_rows_by_pair, entity_revisions, series_revisions
from vintager.plans import relational
from vintager.plans.audit import audit_complete, audit_fail, audit_start
from vintager.session import ensure_checkpoint_dir
from vintager.sources.landing import FILE, one_publication, publish_range, read_landing, united
from vintager.sources.snapshots import canonical_history
from vintager.sources.store import (
    REJECTED,
    admit,
    append_if_absent,
    append_new_publications,
    manifest_path,
    new_rows,
    publication_status,
    read_manifest,
    read_store,
)
from vintager.sources.tables import (
    path_exists,
    read_dataset,
    upsert,
    verify_load,
    write_parquet,
    write_tables,
)
from vintager.sources.versions import read_version

GROUP_HISTORY = "fuel_availability_history"
SYSTEM_HISTORY = "system_availability_history"
ENTITY_REVISIONS = "unit_revision_history"
GROUP_REVISIONS = "fuel_revision_history"
SYSTEM_REVISIONS = "system_revision_history"
LATEST_GROUP = "latest_fuel_availability"
LATEST_SYSTEM = "latest_system_availability"
LATEST_UNIT_REVISIONS = "latest_unit_revisions"
LATEST_GROUP_REVISIONS = "latest_fuel_revisions"
LATEST_SYSTEM_REVISIONS = "latest_system_revisions"
DATASETS = [GROUP_HISTORY, SYSTEM_HISTORY, ENTITY_REVISIONS, GROUP_REVISIONS, SYSTEM_REVISIONS]


def build_datasets(df: DataFrame, c: Columns = DEFAULT) -> dict[str, DataFrame]:
    """The five history datasets as lazy plans. One count sizes the aggregated series."""
    chunk = chunk_unit(df, c.published)
    by_group = group_history(df, c)
    system = system_history(by_group, c)
    return {
        GROUP_HISTORY: by_group,
        SYSTEM_HISTORY: system,
        ENTITY_REVISIONS: entity_revisions(df, c),
        GROUP_REVISIONS: series_revisions(by_group, c.group_series, c, chunk),
        SYSTEM_REVISIONS: series_revisions(system, c.total_series, c, chunk),
    }


@dataclass
class ParquetSink:
    """Overwrites ``<directory>/<dataset>``, partitioned by publication date if asked for."""

    directory: str
    by_date: bool = False

    def write(self, name: str, df: DataFrame) -> str:
        return write_parquet({name: df}, self.directory, self.by_date)[name]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.directory}/{name}")


@dataclass
class TableSink:
    """Overwrites managed tables ``<namespace>.<dataset>``, likewise."""

    namespace: str
    fmt: str = "parquet"
    by_date: bool = False

    def write(self, name: str, df: DataFrame) -> str:
        return write_tables({name: df}, self.namespace, self.fmt, self.by_date)[name]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.table(f"{self.namespace}.{name}")


def run_history_job(
    spark: SparkSession,
    source: str | DataFrame,
    sink: ParquetSink | TableSink,
    c: Columns = DEFAULT,
) -> dict:
    """Read, validate, build and write the five datasets.

    Row counts are observed during the writes instead of counted by extra jobs. The
    aggregate histories are written first and the datasets derived from them read the
    written copy, so the canonical rows are scanned for the quality verdict, the group
    history and the entity revisions only.
    """
    df = canonical_history(spark, source) if isinstance(source, str) else source
    df = df.drop(PUBLISH_DATE)
    quality = assert_quality(df, c)
    chunk = chunk_unit(df, c.published)
    outputs: dict[str, str] = {}
    counts: dict[str, int] = {}

    def store(name: str, rows: DataFrame) -> DataFrame:
        seen = Observation(name)
        outputs[name] = sink.write(name, rows.observe(seen, F.count(F.lit(1)).alias("rows")))
        counts[name] = seen.get["rows"]
        return sink.read(spark, name).drop(PUBLISH_DATE)

    by_group = store(GROUP_HISTORY, group_history(df, c))
    system = store(SYSTEM_HISTORY, system_history(by_group, c))
    store(ENTITY_REVISIONS, entity_revisions(df, c))
    store(GROUP_REVISIONS, series_revisions(by_group, c.group_series, c, chunk))
    store(SYSTEM_REVISIONS, series_revisions(system, c.total_series, c, chunk))
    return {"quality": quality, "row_counts": counts, "outputs": outputs}


def history_report(df: DataFrame, c: Columns = DEFAULT) -> dict[str, DataFrame]:
    """Dataset row counts and changed rows by pair."""
    datasets = build_datasets(df, c)
    counts: DataFrame | None = None
    for name in DATASETS:
        line = datasets[name].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("dataset"), "rows"
        )
        counts = line if counts is None else counts.unionByName(line)
    return {
        "row_counts": counts,
        "changed_rows": changed_rows_by_pair(datasets[ENTITY_REVISIONS]),
    }


def ingest_landing(
    spark: SparkSession, landing: str, store: str, c: Columns = DEFAULT
) -> DataFrame:
    """Judge the new publications of the landing files and store the good ones.

    Returns one row per publication with its status; refused ones are in the store's
    quarantine. Each file is parsed once.
    """
    rows = read_landing(spark, landing, c=c, files=True).persist()
    try:
        return admit(rows, store, c)
    finally:
        rows.unpersist()


def collect_and_run(
    spark: SparkSession,
    landing: str,
    store: str,
    sink: ParquetSink | TableSink,
    c: Columns = DEFAULT,
) -> dict:
    """Store what landed, then rebuild the history datasets from the store."""
    ingested = ingest_landing(spark, landing, store, c)
    result = run_history_job(spark, read_store(spark, store), sink, c)
    return {"ingested": ingested, **result}


def backfill(
    df: DataFrame,
    start: datetime | str,
    end: datetime | str,
    store: str,
    c: Columns = DEFAULT,
) -> DataFrame:
    """Store the publications of a range in one pass; returns the one-row summary.

    Each publication is judged on its own: those with duplicated keys are left out and named in
    the error that is raised once the others are stored.
    """
    rows = publish_range(df, start, end, c=c).filter(F.col(c.published).isNotNull())
    rows = united(rows, c) if FILE in rows.columns else rows
    if rows.isEmpty():
        return backfill_summary(publication_status(rows, rows, c))
    ensure_checkpoint_dir(df.sparkSession)
    listed = rows.limit(0)
    if path_exists(df.sparkSession, manifest_path(store)):
        listed = read_manifest(df.sparkSession, store)
    bad = ingest_report(new_rows(rows, listed, c), c).filter("duplicate_key_rows > 0")
    bad = bad.select(c.published, "duplicate_key_rows").checkpoint()
    good = new_rows(rows, bad, c)
    status = append_new_publications(good, store, c)
    if not bad.isEmpty():
        total = bad.agg(F.sum("duplicate_key_rows")).first()[0]
        named = ", ".join(str(r[0]) for r in bad.orderBy(c.published).limit(20).collect())
        raise QualityError(f"{total} rows share a source key, in publications {named}.")
    return backfill_summary(status)


def backfill_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_returned"),
        F.count(F.lit(1)).alias("publications_found"),
        F.count_if("created").alias("publications_created"),
        F.count_if(~F.col("created")).alias("publications_existing"),
    )


def transform(
    df: DataFrame, directory: str | None = None, c: Columns = DEFAULT
) -> dict[str, DataFrame]:
    """One publication's rows with its group and system availability.

    With ``directory`` both are written there, and the returned frames read it.
    """
    rows = one_publication(df, c=c)
    built = {
        LATEST_GROUP: availability(rows, [c.group], c),
        LATEST_SYSTEM: availability(rows, [], c),
    }
    if directory is not None:
        paths = write_parquet(built, directory)
        built = {name: df.sparkSession.read.parquet(path) for name, path in paths.items()}
    return {"raw": rows, **built}


def latest_pair_job(df: DataFrame, directory: str | None = None, c: Columns = DEFAULT) -> dict:
    """Revisions of the two newest publications with rollups and top movers.

    ``status`` is 'waiting' while there are fewer than two publications.
    """
    require_publications(df)
    two = latest_publications(df, 2, c)
    if two.isEmpty():
        return {"status": "waiting"}
    latest = two.agg(F.max(c.published)).scalar()
    published = F.col(c.published)
    unit = pair_revisions(two.filter(published < latest), two.filter(published == latest), c)
    if directory is not None:
        path = write_parquet({LATEST_UNIT_REVISIONS: unit}, directory)[LATEST_UNIT_REVISIONS]
        unit = df.sparkSession.read.parquet(path)
    rolled = {
        LATEST_GROUP_REVISIONS: rollup_pair(unit, [c.group], c),
        LATEST_SYSTEM_REVISIONS: rollup_pair(unit, [], c),
    }
    if directory is not None:
        write_parquet(rolled, directory)
    return {
        "status": "built",
        LATEST_UNIT_REVISIONS: unit,
        **rolled,
        "top_downward": top_pair_movers(unit, False, c=c),
        "top_upward": top_pair_movers(unit, True, c=c),
    }


@dataclass
class RelationalTargets:
    """Paths of the relational tables under one root."""

    root: str
    raw: str = field(init=False)
    fuel_availability: str = field(init=False)
    system_availability: str = field(init=False)
    unit_revision: str = field(init=False)
    fuel_revision: str = field(init=False)
    system_revision: str = field(init=False)

    def __post_init__(self) -> None:
        self.raw = f"{self.root}/raw/observations"
        self.fuel_availability = f"{self.root}/silver/fuel_availability"
        self.system_availability = f"{self.root}/silver/system_availability"
        self.unit_revision = f"{self.root}/analytics/unit_availability_revision"
        self.fuel_revision = f"{self.root}/analytics/fuel_availability_revision"
        self.system_revision = f"{self.root}/analytics/system_availability_revision"


def load_availability(
    spark: SparkSession, by_group: DataFrame, system: DataFrame, targets: RelationalTargets
) -> DataFrame:
    """Upsert both availability tables and return stored row counts per publication.

    Both inputs must have rows and cover the same publications.
    """
    group_rows = relational.group_availability(by_group)
    system_rows = relational.system_availability(system)
    for name, rows in (("Group", group_rows), ("System", system_rows)):
        if rows.isEmpty():
            raise QualityError(f"{name} availability has no rows.")
    time = "publish_time"
    uneven = (
        group_rows.select(time)
        .distinct()
        .withColumn("_g", F.lit(1))
        .join(system_rows.select(time).distinct().withColumn("_s", F.lit(1)), time, "full_outer")
        .filter("_g IS NULL OR _s IS NULL")
    )
    if not uneven.isEmpty():
        raise QualityError("Group and system availability cover different publications.")
    upsert(spark, targets.fuel_availability, group_rows, schema.GROUP_AVAILABILITY_KEY, time)
    upsert(spark, targets.system_availability, system_rows, schema.SYSTEM_AVAILABILITY_KEY, time)
    return verify_load(
        read_version(spark, targets.fuel_availability),
        read_version(spark, targets.system_availability),
        time,
    ).select(
        time,
        F.col("source_rows").alias("fuel_rows"),
        F.col("target_rows").alias("system_rows"),
    )


def load_revisions(
    spark: SparkSession,
    unit: DataFrame,
    by_group: DataFrame,
    system: DataFrame,
    targets: RelationalTargets,
) -> dict[str, int]:
    """Upsert unit, group and system revisions of any number of pairs."""
    time = "latest_publish_time"
    return {
        "unit_rows": upsert(
            spark,
            targets.unit_revision,
            relational.unit_revisions(unit),
            schema.UNIT_REVISION_KEY,
            time,
        ),
        "fuel_rows": upsert(
            spark,
            targets.fuel_revision,
            relational.group_revisions(by_group),
            schema.GROUP_REVISION_KEY,
            time,
        ),
        "system_rows": upsert(
            spark,
            targets.system_revision,
            relational.system_revisions(system),
            schema.SYSTEM_REVISION_KEY,
            time,
        ),
    }


def load_written_availability(
    spark: SparkSession, directory: str, targets: RelationalTargets
) -> DataFrame:
    """Load what ``transform`` wrote; a missing dataset is an error."""
    return load_availability(
        spark,
        read_dataset(spark, f"{directory}/{LATEST_GROUP}"),
        read_dataset(spark, f"{directory}/{LATEST_SYSTEM}"),
        targets,
    )


def load_written_revisions(
    spark: SparkSession, directory: str, targets: RelationalTargets
) -> dict[str, int]:
    """Load what ``latest_pair_job`` wrote; a missing dataset is an error."""
    return load_revisions(
        spark,
        read_dataset(spark, f"{directory}/{LATEST_UNIT_REVISIONS}"),
        read_dataset(spark, f"{directory}/{LATEST_GROUP_REVISIONS}"),
        read_dataset(spark, f"{directory}/{LATEST_SYSTEM_REVISIONS}"),
        targets,
    )


def replay(df: DataFrame, targets: RelationalTargets, c: Columns = DEFAULT) -> dict:
    """Load the whole history: raw rows, availability, and all adjacent pairs at once.

    The rollups read the unit revisions just stored rather than matching again.
    """
    spark = df.sparkSession
    require_rows(df)
    raw = append_if_absent(spark, targets.raw, relational.raw_rows(df), "publish_time")
    silver = load_availability(
        spark, availability(df, [c.group], c), availability(df, [], c), targets
    )
    time = "latest_publish_time"
    unit_rows = upsert(
        spark,
        targets.unit_revision,
        relational.unit_revisions(all_pair_revisions(df, c)),
        schema.UNIT_REVISION_KEY,
        time,
    )
    back = {name: source for source, name, _ in schema.UNIT_REVISION_TABLE}
    unit = read_version(spark, targets.unit_revision).withColumnsRenamed(back)
    fuel_rows = upsert(
        spark,
        targets.fuel_revision,
        relational.group_revisions(rollup_pair(unit, [c.group], c)),
        schema.GROUP_REVISION_KEY,
        time,
    )
    system_rows = upsert(
        spark,
        targets.system_revision,
        relational.system_revisions(rollup_pair(unit, [], c)),
        schema.SYSTEM_REVISION_KEY,
        time,
    )
    pairs = changed_rows_by_adjacent_pair(unit).orderBy(PREVIOUS_TIME, LATEST_TIME)
    return {
        "raw": raw,
        "availability": silver,
        "revision_pairs": pairs,
        "unit_rows": unit_rows,
        "fuel_rows": fuel_rows,
        "system_rows": system_rows,
    }


Stage = tuple[str, Callable[[dict], object]]


def governed_run(
    spark: SparkSession, stages: Sequence[Stage], log: str, name: str, dataset: str
) -> dict:
    """Run stages in order under an audit record.

    Each stage gets the shared context and may put ``publish_time`` and ``rows`` into
    it. A failing stage is recorded by name and its error is raised again.
    """
    run_id = audit_start(spark, log, name, dataset)
    context: dict = {"run_id": run_id, "publish_time": None, "rows": 0}
    current = "initialisation"
    try:
        for current, action in stages:
            context[current] = action(context)
        audit_complete(spark, log, run_id, context["publish_time"], context["rows"])
    except Exception as error:
        message = f"Stage '{current}' failed: {error}"
        audit_fail(spark, log, run_id, message, context["publish_time"])
        raise
    return context


def standard_stages(
    spark: SparkSession,
    landing: str,
    store: str,
    work: str,
    targets: RelationalTargets,
    c: Columns = DEFAULT,
) -> list[Stage]:
    """The six stages of a governed run over the latest publication.

    Stages hand over through the datasets written under ``work``.
    """

    def latest() -> DataFrame:
        return latest_publication(read_store(spark, store), c).select(*c.required)

    def ingest(context: dict) -> DataFrame:
        status = ingest_landing(spark, landing, store, c)
        context["rejected"] = status.filter(F.col("status") == REJECTED).count()
        details = source_details(latest(), c).first()
        context["publish_time"], context["rows"] = details[c.published], details["rows"]
        return status

    def compare(context: dict) -> str:
        context["compared"] = latest_pair_job(read_store(spark, store), work, c)["status"]
        return context["compared"]

    def load_compared(context: dict) -> dict | None:
        if context["compared"] == "waiting":
            return None
        return load_written_revisions(spark, work, targets)

    return [
        ("ingestion", ingest),
        ("availability transformation", lambda context: transform(latest(), work, c)),
        (
            "raw load",
            lambda context: append_if_absent(
                spark, targets.raw, relational.raw_rows(latest()), "publish_time"
            ),
        ),
        ("availability load", lambda context: load_written_availability(spark, work, targets)),
        ("revision intelligence", compare),
        ("revision load", load_compared),
    ]
