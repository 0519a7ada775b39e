"""The publication store: write-once history with a manifest as its commit log.

Layout: ``<store>/data/publish_date=…/publish_stamp=…`` and ``<store>/manifest``.
A publication counts as stored once the manifest lists it. Its data directory is
written before that with dynamic partition overwrite, so a job that dies in between
writes the same directory again on its next run instead of leaving half of it.

Each incoming publication is judged alone. One that fails goes to ``<store>/quarantine``:
its rows to ``rows`` (laid out like ``data``), then its reason to the ``ledger``, which is
to it what the manifest is to a stored one. While the ledger holds it, it is not judged
again; ``release`` lets the next run do so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintager.columns import DEFAULT, PUBLISH_DATE, Columns
from vintager.functions.scalars import publication_stamp
from vintager.operators.publications import NoPublications
from vintager.operators.quality import ingest_report, require_columns, require_rows
from vintager.operators.sizing import broadcast_if_small
from vintager.session import ensure_checkpoint_dir
from vintager.sources.landing import FILE, FILE_TIME, united
from vintager.sources.tables import path_exists, remove_path
from vintager.sources.versions import days_of, publish, read_version, version, write_files

STAMP = "publish_stamp"
# What became of an incoming publication: stored now, stored before, refused now, refused before.
CREATED, EXISTING, REJECTED, QUARANTINED = "created", "existing", "rejected", "quarantined"
RELEASED = "released"
# Files that runs may append to the manifest before they are gathered into a checkpoint.
MANIFEST_FILES = 100
UNDATED = "no publication time"


def publication_manifest(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """One row per publication: counts, distinct units and groups, target date range.

    The three distinct counts expand rows already reduced to one per unit and group.
    """
    reduced = df.groupBy(c.published, c.entity, c.alias, c.group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(c.target).alias("_low"),
        F.max(c.target).alias("_high"),
    )
    width = len([name for name in df.columns if name not in (PUBLISH_DATE, STAMP)])
    return reduced.groupBy(c.published).agg(
        F.sum("_n").alias("rows"),
        F.lit(width).alias("columns"),
        F.count_distinct(c.entity).alias("distinct_units"),
        F.count_distinct(c.alias).alias("distinct_aliases"),
        F.count_distinct(c.group).alias("distinct_groups"),
        F.min("_low").alias("earliest_target"),
        F.max("_high").alias("latest_target"),
    )


def described_publications(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """The manifest with each publication's ingest report and the time of writing."""
    return (
        publication_manifest(df, c)
        .join(ingest_report(df, c).drop("row_count"), c.published)
        .withColumn("collected_at", F.current_timestamp())
    )


def data_path(store: str) -> str:
    return f"{store}/data"


def manifest_path(store: str) -> str:
    return f"{store}/manifest"


def _manifest_files(spark: SparkSession, store: str) -> list[str]:
    """Names of the files that runs appended to the manifest and that are still there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(manifest_path(store))
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(n for n in names if n.endswith(".parquet"))


def _manifest_checkpoint(spark: SparkSession, store: str) -> tuple[int, str | None, list[str]]:
    """Number and path of the newest complete checkpoint, and the files that it stands for."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{store}/manifest_checkpoints")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return 0, None, []
    known = sorted((int(s.getPath().getName()) for s in fs.listStatus(folder)), reverse=True)
    for number in known:
        path = f"{store}/manifest_checkpoints/{number}"
        # The rows are written last, and their marker when all of them are there.
        if path_exists(spark, f"{path}/rows/_SUCCESS"):
            return number, path, [r[0] for r in spark.read.text(f"{path}/files").collect()]
    return 0, None, []


def read_manifest(spark: SparkSession, store: str) -> DataFrame:
    """One row per stored publication: the newest checkpoint and the files appended since."""
    if not path_exists(spark, manifest_path(store)):
        raise NoPublications(f"No publications are stored under {store}.")
    _, checkpoint, covered = _manifest_checkpoint(spark, store)
    if checkpoint is None:
        return spark.read.parquet(manifest_path(store))
    done = set(covered)
    tail = [f"{manifest_path(store)}/{n}" for n in _manifest_files(spark, store) if n not in done]
    return spark.read.parquet(f"{checkpoint}/rows", *tail)


def compact_manifest(spark: SparkSession, store: str, most: int = MANIFEST_FILES) -> bool:
    """Gather the manifest into a checkpoint once more than ``most`` files were appended to it.

    The files that a checkpoint stands for, and the checkpoint before it, are deleted by the
    compaction after it, so readers that listed them still find them. A compaction that dies
    changes nothing: its checkpoint has no marker, and the next one takes its place.
    """
    number, _, covered = _manifest_checkpoint(spark, store)
    files = _manifest_files(spark, store)
    if len(set(files) - set(covered)) <= most:
        return False
    after = f"{store}/manifest_checkpoints/{number + 1}"
    remove_path(spark, after)
    lines = spark.createDataFrame([(name,) for name in files], "value string")
    lines.coalesce(1).write.text(f"{after}/files")
    read_manifest(spark, store).hint("rebalance").write.parquet(f"{after}/rows")
    for name in covered:
        remove_path(spark, f"{manifest_path(store)}/{name}")
    remove_path(spark, f"{store}/manifest_checkpoints/{number - 1}")
    return True


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The stored history, with ``publish_date`` as a partition column to prune by."""
    if not path_exists(spark, manifest_path(store)):
        raise NoPublications(f"No publications are stored under {store}.")
    return spark.read.parquet(data_path(store)).drop(STAMP)


def new_rows(df: DataFrame, stored: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """Rows of publications that ``stored`` (any rows with their times) lacks.

    ``stored`` shrinks to one row per publication and is broadcast if that is small;
    ``df`` is then filtered without a shuffle, however large one publication is.
    """
    times = stored.select(c.published).distinct()
    return df.join(broadcast_if_small(times), c.published, "left_anti")


def publication_status(df: DataFrame, stored: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """For each incoming publication: whether it would be created, and its rows."""
    incoming = (
        df.filter(F.col(c.published).isNotNull())
        .groupBy(c.published)
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    known = stored.select(c.published).distinct().withColumn("_stored", F.lit(True))
    return incoming.join(known, c.published, "left").select(
        c.published, "rows", F.col("_stored").isNull().alias("created")
    )


def load_status(df: DataFrame, target: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """As an append-if-absent load would report: already loaded with the rows there,
    or loaded with the rows given."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(c.published).agg(F.count(F.lit(1)).alias(name))

    both = counted(df.filter(F.col(c.published).isNotNull()), "_given").join(
        counted(target, "_there"), c.published, "left"
    )
    return both.select(
        c.published,
        F.when(F.col("_there").isNotNull(), "already_loaded").otherwise("loaded").alias("status"),
        F.coalesce("_there", "_given").alias("rows"),
    )


def append_new_publications(df: DataFrame, store: str, c: Columns = DEFAULT) -> DataFrame:
    """Store each publication once; returns publication, rows and created.

    A publication that is already listed is left untouched, whatever its rows say.
    The returned status is checkpointed, so it does not change after the write.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    incoming = df.filter(F.col(c.published).isNotNull())
    listed = incoming.select(c.published).limit(0)
    if path_exists(spark, manifest_path(store)):
        listed = read_manifest(spark, store).select(c.published)
    outcome = publication_status(incoming, listed, c).checkpoint()
    created = outcome.filter("created").select(c.published)
    if created.isEmpty():
        return outcome
    (
        new_rows(incoming, listed, c)
        .withColumn(PUBLISH_DATE, F.to_date(c.published))
        .withColumn(STAMP, publication_stamp(F.col(c.published)))
        .hint("rebalance", PUBLISH_DATE, STAMP)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PUBLISH_DATE, STAMP)
        .parquet(data_path(store))
    )
    # Describe what was written, reading only the days just written to.
    days = created.agg(
        F.struct(
            F.min(F.to_date(c.published)).alias("low"), F.max(F.to_date(c.published)).alias("high")
        )
    ).scalar()
    written = spark.read.parquet(data_path(store)).filter(
        F.col(PUBLISH_DATE).between(days.getField("low"), days.getField("high"))
    )
    committed = written.join(broadcast_if_small(created), c.published, "left_semi")
    manifest = described_publications(committed, c)
    # One row per publication: adaptive execution makes few files of them, in parallel.
    manifest.hint("rebalance").write.mode("append").parquet(manifest_path(store))
    compact_manifest(spark, store)
    return outcome


def quarantine_rows_path(store: str) -> str:
    return f"{store}/quarantine/rows"


def quarantine_ledger_path(store: str) -> str:
    return f"{store}/quarantine/ledger"


def read_quarantine(spark: SparkSession, store: str, c: Columns = DEFAULT) -> DataFrame:
    """The publications now in quarantine: rows, reason, since when, and where their rows lie.

    The ledger is a log of events; the newest one of a publication decides.
    """
    schema = (
        f"{c.published} timestamp, rows long, reason string, event string, recorded_at timestamp"
    )
    path = quarantine_ledger_path(store)
    if path_exists(spark, path):
        log = spark.read.schema(schema).parquet(path)
    else:
        log = spark.createDataFrame([], schema)
    newest = log.groupBy(c.published).agg(
        F.max(F.struct("recorded_at", "event", "rows", "reason")).alias("_last")
    )
    return newest.filter(F.col("_last.event") == REJECTED).select(
        c.published,
        "_last.rows",
        "_last.reason",
        F.col("_last.recorded_at").alias("rejected_at"),
        F.concat(
            F.lit(f"{quarantine_rows_path(store)}/{PUBLISH_DATE}="),
            F.date_format(c.published, "yyyy-MM-dd"),
            F.lit(f"/{STAMP}="),
            publication_stamp(F.col(c.published)),
        ).alias("dead_letters"),
    )


def release(spark: SparkSession, store: str, times: DataFrame, c: Columns = DEFAULT) -> None:
    """Take publications out of quarantine; the next run judges them anew. Their rows stay."""
    held = read_quarantine(spark, store, c).join(
        broadcast_if_small(times.select(c.published).distinct()), c.published, "left_semi"
    )
    _record(held, RELEASED, store, c)


def _record(verdicts: DataFrame, event: str, store: str, c: Columns) -> None:
    verdicts.select(
        c.published,
        "rows",
        "reason",
        F.lit(event).alias("event"),
        F.current_timestamp().alias("recorded_at"),
    ).write.mode("append").parquet(quarantine_ledger_path(store))


def quarantine(rows: DataFrame, verdicts: DataFrame, store: str, c: Columns = DEFAULT) -> None:
    """Put the rows of refused publications aside, then name them with their reason."""
    (
        rows.withColumn(PUBLISH_DATE, F.to_date(c.published))
        .withColumn(STAMP, publication_stamp(F.col(c.published)))
        .hint("rebalance", PUBLISH_DATE, STAMP)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PUBLISH_DATE, STAMP)
        .parquet(quarantine_rows_path(store))
    )
    _record(verdicts, REJECTED, store, c)


def ingest_verdicts(df: DataFrame, c: Columns = DEFAULT) -> DataFrame:
    """One row per publication of ``df``: rows, and the reason for refusing it or NULL."""
    shared = F.col("duplicate_key_rows")
    return ingest_report(df, c).select(
        c.published,
        F.col("row_count").alias("rows"),
        F.when(shared > 0, F.concat(shared.cast("string"), F.lit(" rows share a source key"))).alias(
            "reason"
        ),
    )


def _fresh(df: DataFrame, known: DataFrame, c: Columns) -> DataFrame:
    """Rows of publications that nothing is known of, each publication's files united."""
    rows = new_rows(df.filter(F.col(c.published).isNotNull()), known, c)
    return united(rows, c) if FILE in df.columns else rows


def ingest_outcome(
    df: DataFrame, stored: DataFrame, quarantined: DataFrame, c: Columns = DEFAULT
) -> DataFrame:
    """What ingesting ``df`` means for each of its publications: rows, status, reason.

    ``stored`` and ``quarantined`` hold the times known already; these publications are
    counted, not judged. Rows without a publication time belong to none: they are named in
    one line with a NULL time and stored nowhere.
    """
    known = stored.select(c.published, F.lit(EXISTING).alias("status")).unionByName(
        quarantined.select(c.published, F.lit(QUARANTINED).alias("status"))
    ).distinct()
    judged = ingest_verdicts(_fresh(df, known, c), c).select(
        c.published,
        "rows",
        F.when(F.col("reason").isNull(), CREATED).otherwise(REJECTED).alias("status"),
        "reason",
    )
    nothing = F.lit(None).cast("string").alias("reason")
    seen = (
        df.groupBy(c.published)
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(known, c.published)
        .select(c.published, "rows", "status", nothing)
    )
    undated = (
        df.filter(F.col(c.published).isNull())
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter("rows > 0")
        .select(
            F.lit(None).cast("timestamp").alias(c.published),
            "rows",
            F.lit(REJECTED).alias("status"),
            F.lit(UNDATED).alias("reason"),
        )
    )
    return judged.unionByName(seen).unionByName(undated)


def admit(df: DataFrame, store: str, c: Columns = DEFAULT) -> DataFrame:
    """Judge the new publications of ``df``, store the good ones and quarantine the others.

    Returns the outcome (see ``ingest_outcome``) with ``created``, checkpointed. Both writes
    repeat what a run that died before them would have written: data and dead letters by
    overwriting their own directories, the logs last. Rows that carry their file are united.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    require_columns(df, c)
    require_rows(df)
    stored = df.select(c.published).limit(0)
    if path_exists(spark, manifest_path(store)):
        stored = read_manifest(spark, store).select(c.published)
    held = read_quarantine(spark, store, c).select(c.published)
    outcome = ingest_outcome(df, stored, held, c).checkpoint()
    fresh = _fresh(df, stored.union(held), c)
    dated = outcome.filter(F.col(c.published).isNotNull())
    refused = dated.filter(F.col("status") == REJECTED)
    good = dated.filter(F.col("status") == CREATED).select(c.published)

    def of(times: DataFrame) -> DataFrame:
        return fresh.join(broadcast_if_small(times.select(c.published)), c.published, "left_semi")

    if not refused.isEmpty():
        quarantine(of(refused), refused, store, c)
    if not good.isEmpty():
        append_new_publications(of(good), store, c)
    return outcome.withColumn("created", F.col("status") == CREATED)


def append_if_absent(spark: SparkSession, path: str, source: DataFrame, time: str) -> DataFrame:
    """Append the publications of ``source`` that the versioned table at ``path`` has no row of.

    The table is partitioned by publication date. All rows of the run become visible by one
    rename, so a run that dies before leaves no publication half loaded: the next run finds
    none of them and loads them whole. Returns publication, status ('loaded' or
    'already_loaded') and rows.
    """
    ensure_checkpoint_dir(spark)
    c = Columns(published=time)
    incoming = source.filter(F.col(time).isNotNull())
    base = version(spark, path)
    target = read_version(spark, path, base) if base.live else incoming.limit(0)
    outcome = load_status(incoming, target, c).checkpoint()
    loaded = outcome.filter(F.col("status") == "loaded").select(F.to_date(time).alias(PUBLISH_DATE))
    if not loaded.isEmpty():
        name = write_files(new_rows(incoming, target, c).withColumn(PUBLISH_DATE, F.to_date(time)), path)
        added = {day: [*base.live.get(day, []), name] for day in days_of(loaded)}
        publish(spark, path, base, base.live | added)
    return outcome
