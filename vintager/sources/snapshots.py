"""Publication snapshot files: listing, mixed-type reads, and timestamp repair.

Snapshots come from different writers, so the same column can be integer in one
file, floating point in the next and without any type (all NULL) in a third. One
scan over all of them fails, so the footers are read first (on the executors), the
files are grouped by their types, and each group is scanned natively and cast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vintager.operators.publications import NoPublications
from vintager.schema import CANONICAL
from vintager.session import use_utc

SNAPSHOT_GLOB = "*_publish_*.parquet"
NANOS = "timestamp[ns"


def list_snapshots(spark: SparkSession, path: str, pattern: str = SNAPSHOT_GLOB) -> DataFrame:
    """Paths of the snapshot files. File contents are not read."""
    try:
        return (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .load(path)
            .select("path")
        )
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise NoPublications(f"No publications under {path}.") from error
        raise


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs
    import pyarrow.parquet as pq

    for batch in batches:
        paths, types = [], []
        for path in batch.column("path").to_pylist():
            uri = path.replace("file:///", "/").replace("file:/", "/")
            filesystem, name = pyarrow.fs.FileSystem.from_uri(uri)
            stored = pq.read_metadata(name, filesystem=filesystem).schema
            kinds = {field.name: str(field.type) for field in stored.to_arrow_schema()}
            for i in range(len(stored)):
                column = stored.column(i)
                if column.physical_type == "INT96":
                    kinds[column.name] = "int96"
            paths.append(path)
            types.append(";".join(f"{name}={kinds[name]}" for name in sorted(kinds)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(types, pa.string())], ["path", "types"]
        )


def snapshot_footers(spark: SparkSession, path: str, pattern: str = SNAPSHOT_GLOB) -> DataFrame:
    """Path and column types of every snapshot; the footers are read by the executors."""
    files = list_snapshots(spark, path, pattern)
    return files.mapInArrow(_footers, "path string, types string")


def _lenient(df: DataFrame, field: T.StructField) -> Column:
    """Cast one column of one file group to its canonical type; junk becomes NULL."""
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    source = F.col(field.name)
    kind = df.schema[field.name].dataType
    if isinstance(kind, T.LongType) and isinstance(field.dataType, (T.TimestampType, T.DateType)):
        # A nanosecond timestamp read as a long.
        source = F.timestamp_micros(F.expr(f"`{field.name}` div 1000"))
    if isinstance(kind, T.StringType) and isinstance(field.dataType, (T.TimestampType, T.DateType)):
        source = F.try_to_timestamp(source)
        return source.cast(field.dataType).alias(field.name)
    if isinstance(kind, T.DoubleType):
        source = F.when(~F.isnan(source), source)
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.StringType)):
        return source.cast(field.dataType).alias(field.name)
    return source.try_cast(field.dataType).alias(field.name)


def canonical_history(
    spark: SparkSession,
    path: str,
    pattern: str = SNAPSHOT_GLOB,
    schema: T.StructType = CANONICAL,
) -> DataFrame:
    """All snapshot files under ``path`` as one canonical DataFrame.

    The driver only handles file paths, as any Parquet scan does. There is one scan
    per distinct set of column types, which is a handful.
    """
    footers = snapshot_footers(spark, path, pattern)
    groups: dict[str, list[str]] = {}
    for row in footers.toLocalIterator():
        groups.setdefault(row["types"], []).append(row["path"])
    if not groups:
        raise NoPublications(f"No publications under {path}.")
    parts = []
    for types in sorted(groups):
        df = _scan(spark, groups[types], NANOS in types)
        missing = [f.name for f in schema if f.name not in df.columns]
        if missing:
            raise ValueError(f"Snapshots lack columns {missing}, e.g. {groups[types][0]}.")
        parts.append(df.select(*[_lenient(df, field) for field in schema]))
    history = parts[0]
    for part in parts[1:]:
        history = history.unionByName(part)
    return history


def _scan(spark: SparkSession, paths: list[str], nanos: bool) -> DataFrame:
    """The files as they are; nanosecond timestamps as longs.

    There is no per-read form of that, so such files are scanned by a session of their own,
    whose setting the caller's never sees. The union puts the rows into the caller's session.
    """
    if not nanos:
        return spark.read.parquet(*paths)
    own = use_utc(spark.newSession())
    own.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    rows = own.read.parquet(*paths)
    return spark.createDataFrame([], rows.schema).union(rows)


def repair_timestamps(
    spark: SparkSession, source: str, target: str, pattern: str = SNAPSHOT_GLOB
) -> DataFrame:
    """Rewrite the snapshots that hold nanosecond timestamps, truncated to microseconds.

    The repaired rows go to ``target``; the source files stay as they are, and a
    directory without such files writes nothing. Returns the repaired paths.
    """
    footers = snapshot_footers(spark, source, pattern)
    repaired = footers.filter(F.col("types").contains(NANOS)).select("path", "types")
    groups: dict[str, list[str]] = {}
    for row in repaired.toLocalIterator():
        groups.setdefault(row["types"], []).append(row["path"])
    for types in sorted(groups):
        nanos = {t.split("=")[0] for t in types.split(";") if NANOS in t.split("=", 1)[1]}
        df = _scan(spark, groups[types], True)
        columns = [
            F.timestamp_micros(F.expr(f"`{name}` div 1000")).alias(name)
            if name in nanos
            else F.col(name)
            for name in df.columns
        ]
        _write_micros(spark, df.select(*columns), target)
    return repaired.select("path")


def _write_micros(spark: SparkSession, df: DataFrame, target: str) -> None:
    """Append with timestamps stored as 64-bit microseconds (the writer has no option)."""
    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_MICROS")
    try:
        df.write.mode("append").parquet(target)
    finally:
        spark.conf.set(name, before)
