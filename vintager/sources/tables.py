"""Sinks over Parquet paths and catalog tables: overwrite, upsert, load checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from vintager.columns import DEFAULT, LATEST_TIME, PUBLISH_DATE
from vintager.session import ensure_checkpoint_dir
from vintager.sources.versions import (
    days_of,
    is_versioned,
    publish,
    read_version,
    version,
    write_files,
)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of Spark's file systems, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_dataset(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table if one has this name, else a (versioned) Parquet path; or an error."""
    if "/" not in name and spark.catalog.tableExists(name):
        return spark.table(name)
    if "/" in name and is_versioned(spark, name):
        return read_version(spark, name)
    if "/" in name and path_exists(spark, name):
        return spark.read.parquet(name)
    raise FileNotFoundError(f"Dataset not found: {name}")


def _writer(df: DataFrame, by_date: bool) -> DataFrameWriter:
    """An overwriting writer, partitioned by publication date if asked for.

    Then ``trailing`` and the "latest" filters over the table read only its last days.
    """
    if not by_date:
        return df.write.mode("overwrite")
    time = LATEST_TIME if LATEST_TIME in df.columns else DEFAULT.published
    dated = df.withColumn(PUBLISH_DATE, F.to_date(time)).hint("rebalance", PUBLISH_DATE)
    return dated.write.mode("overwrite").partitionBy(PUBLISH_DATE)


def write_parquet(
    datasets: dict[str, DataFrame], directory: str, by_date: bool = False
) -> dict[str, str]:
    """Overwrite one Parquet directory per dataset; running it twice changes nothing."""
    paths = {}
    for name, df in datasets.items():
        paths[name] = f"{directory}/{name}"
        _writer(df, by_date).parquet(paths[name])
    return paths


def write_tables(
    datasets: dict[str, DataFrame], namespace: str, fmt: str = "parquet", by_date: bool = False
) -> dict[str, str]:
    """Overwrite one managed table per dataset, replacing its schema too."""
    tables = {}
    for name, df in datasets.items():
        tables[name] = f"{namespace}.{name}"
        writer = _writer(df, by_date).format(fmt)
        if fmt == "delta":
            writer = writer.option("overwriteSchema", "true")
        writer.saveAsTable(tables[name])
    return tables


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``target`` after an upsert: source rows, plus the target rows they do not replace.

    Keys are unique on both sides, so the anti join has no hot key. NULL keys are equal to
    each other, so that loading the same rows again changes nothing.
    """
    replaced = source.select(*[F.col(key).alias(f"_new_{key}") for key in keys])
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_new_{key}")) for key in keys])
    kept = target.join(replaced, same, "left_anti")
    return kept.select(*target.columns).unionByName(source.select(*target.columns))


def upsert(
    spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], time: str
) -> int:
    """Upsert ``source`` into a versioned Parquet table partitioned by the date of ``time``.

    ``time`` is one of the keys, so a row can only replace a row of its own day (rows
    without a time have a partition of their own): only the source's days are read and
    written anew. The source is evaluated once. The new version appears by one rename, so
    a run that dies leaves the old one, and a second writer gets a ``ConcurrentWrite``.
    Returns the number of source rows.
    """
    if time not in keys:
        raise ValueError("The partition time must be part of the key.")
    ensure_checkpoint_dir(spark)
    base = version(spark, path)
    dated = source.withColumn(PUBLISH_DATE, F.to_date(time)).checkpoint()
    check = dated.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.max("_n").alias("copies")
    ).first()
    if check["rows"] == 0:
        return 0
    if check["copies"] > 1:
        raise ValueError("The rows to upsert repeat a key.")
    days = days_of(dated)
    result = dated
    if any(day in base.live for day in days):
        existing = read_version(spark, path, base, days)
        result = merged(existing.select(*dated.columns), dated, keys)
    name = write_files(result, path)
    publish(spark, path, base, base.live | {day: [name] for day in days})
    return check["rows"]


def merge_table(source: DataFrame, table: str, keys: Sequence[str]) -> None:
    """The same upsert as one MERGE, for table formats with row-level operations."""
    on = [F.col(f"{table}.{key}").eqNullSafe(source[key]) for key in keys]
    condition = reduce(and_, on)
    source.mergeInto(table, condition).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def verify_load(source: DataFrame, target: DataFrame, time: str) -> DataFrame:
    """Row counts per publication on both sides; a missing side counts 0."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(time).agg(F.count(F.lit(1)).alias(name))

    both = counted(source, "source_rows").join(
        counted(target, "target_rows"), time, "full_outer"
    )
    return both.select(
        time,
        F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
        F.coalesce("target_rows", F.lit(0)).alias("target_rows"),
    ).withColumn("complete", F.col("source_rows") == F.col("target_rows"))
