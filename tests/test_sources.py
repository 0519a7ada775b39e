"""Snapshot files, landing files, the publication store and the table sinks."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from conftest import rows_of, same_rows, utc
from pyspark.sql import functions as F

from vintager import schema
from vintager.operators.publications import NoPublications, latest_publication
from vintager.operators.quality import QualityError
from vintager.plans import jobs, relational
from vintager.sources import landing, snapshots, store, tables, versions

P0, P1, P2 = utc("2034-09-21"), utc("2034-09-21", 1), utc("2034-09-22")
D = "2034-09-25"


def frame(published, mw, units=("GORSE-3", "TARN-8"), alias=None) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "dataset": "TEST",
            "fuelType": ["HYDRO", "TIDE"][: len(units)],
            "nationalGridBmUnit": list(units),
            "bmUnit": alias,
            "publishTime": pd.Timestamp(published),
            "forecastDate": pd.Timestamp(D),
            "outputUsable": mw,
            "collectedAt": pd.Timestamp("2034-09-21T19:45:30.654321Z"),
        }
    )


def save(df: pd.DataFrame, path, unit="us") -> None:
    df.to_parquet(path, index=False, coerce_timestamps=unit if unit == "us" else None,
                  **({"allow_truncated_timestamps": True} if unit == "us" else {}))


@pytest.fixture
def mixed(tmp_path):
    """Integer, floating and text measures, an all-NULL column, and one ns file."""
    save(frame(P0, [64, 12], alias=["A-GORSE", "A-TARN"]), tmp_path / "x_publish_20340921T000000Z.parquet")
    save(frame(P1, [63.25, None]), tmp_path / "x_publish_20340921T010000Z.parquet")
    text = frame(P2, ["58.125", "bad"])
    text["forecastDate"] = [D, "n/a"]
    save(text, tmp_path / "x_publish_20340922T000000Z.parquet")
    (tmp_path / "x_publish_20340922T000000Z_metadata.json").write_text("{}")
    return tmp_path


def add_nanos(directory):
    df = frame(utc("2034-09-22", 1), [1, 2])
    df["collectedAt"] = pd.Timestamp("2034-09-21T19:45:30.654321987Z")
    for name in ("publishTime", "collectedAt"):
        df[name] = df[name].astype("datetime64[ns, UTC]")
    df.to_parquet(directory / "x_publish_20340922T010000Z.parquet", index=False)


def test_mixed_snapshot_types_become_one_history(spark, mixed):
    df = snapshots.canonical_history(spark, str(mixed))
    assert df.schema.simpleString() == schema.CANONICAL.simpleString()
    rows = {
        (r["nationalGridBmUnit"], r["h"]): r
        for r in df.withColumn("h", F.date_format("publishTime", "ddHH")).collect()
    }
    assert len(rows) == 6
    assert float(rows["GORSE-3", "2100"]["outputUsable"]) == 64.0
    assert float(rows["GORSE-3", "2101"]["outputUsable"]) == 63.25
    assert rows["TARN-8", "2101"]["outputUsable"] is None
    assert rows["GORSE-3", "2100"]["bmUnit"] == "A-GORSE" and rows["GORSE-3", "2101"]["bmUnit"] is None
    assert rows["TARN-8", "2200"]["outputUsable"] is None
    assert rows["TARN-8", "2200"]["forecastDate"] is None
    assert str(rows["GORSE-3", "2200"]["forecastDate"]) == D


def test_nanosecond_snapshots_are_read_and_repaired(spark, mixed, tmp_path_factory):
    add_nanos(mixed)
    setting = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(setting)
    df = snapshots.canonical_history(spark, str(mixed))
    assert df.count() == 8
    assert (df.sparkSession, spark.conf.get(setting)) == (spark, before) and before == "false"
    assert df.filter("collectedAt = timestamp'2034-09-21 19:45:30.654321'").count() == 8
    target = str(tmp_path_factory.mktemp("repaired") / "out")
    repaired = snapshots.repair_timestamps(spark, str(mixed), target)
    assert [r["path"].rsplit("/", 1)[1] for r in repaired.collect()] == [
        "x_publish_20340922T010000Z.parquet"
    ]
    fixed = spark.read.parquet(target)
    assert dict(fixed.dtypes)["collectedAt"] == "timestamp"
    assert fixed.filter("collectedAt = timestamp'2034-09-21 19:45:30.654321'").count() == 2
    again = snapshots.repair_timestamps(spark, target, target + "2", "*.parquet")
    assert again.isEmpty() and not tables.path_exists(spark, target + "2")


def test_no_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(NoPublications):
        snapshots.canonical_history(spark, str(tmp_path))
    with pytest.raises(NoPublications):
        snapshots.canonical_history(spark, str(tmp_path / "absent"))


def record(published, unit="GORSE-3", fuel="HYDRO", mw=64.5, target=D):
    return {
        "dataset": "TEST",
        "fuelType": fuel,
        "nationalGridBmUnit": unit,
        "bmUnit": None,
        "publishTime": published,
        "forecastDate": target,
        "outputUsable": mw,
    }


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    both = [
        record("2034-09-21T00:00:00Z"),
        record("2034-09-21T00:00:00Z", "TARN-8", "TIDE", 12),
        record("2034-09-21T03:00:00+02:00", "GORSE-3", "HYDRO", 66.25),
        record("2034-09-21T01:00:00Z", "TARN-8", "TIDE", 12),
    ]
    (folder / "a.json").write_text(json.dumps(both))
    return folder


def test_landing_is_parsed_in_utc_and_leniently(spark, landed):
    (landed / "b.json").write_text(json.dumps([record("soon", mw="much", target="never")]))
    df = landing.read_landing(spark, str(landed))
    assert df.select("publishTime").distinct().count() == 3
    bad = df.filter("publishTime IS NULL").first()
    assert bad["outputUsable"] is None and bad["forecastDate"] is None
    assert df.filter(F.col("publishTime") == F.lit(P1)).count() == 2
    assert landing.read_landing(spark, str(landed), groups=["TIDE"]).count() == 2
    assert landing.read_landing(spark, str(landed), groups=["TIDE"], entities=["GORSE-3"]).isEmpty()
    assert landing.select_listed(df, [], None).count() == 5


def test_publish_range_is_inclusive_and_in_utc(spark):
    df = rows_of(spark, [("U", "X", t, D, 1) for t in (P0, P1, P2)])
    assert landing.publish_range(df, "2034-09-21T01:00:00+01:00", "2034-09-21T01:00:00").count() == 2
    with pytest.raises(ValueError):
        landing.publish_range(df, "2034-09-21T01:00:00", "2034-09-21T02:00:00+01:00")


def test_split_publications(spark):
    df = rows_of(spark, [("B", "X", P1, D, 1), ("A", "X", P1, D, 2), ("A", "X", P0, D, 3), ("Z", "X", None, D, 4)])
    split = landing.split_publications(df)
    assert split.count() == 3
    assert landing.split_publications(df.limit(0)).isEmpty()
    with pytest.raises(QualityError):
        landing.split_publications(df.drop("publishTime"))


def test_one_publication(spark):
    df = rows_of(spark, [("A", "X", P0, D, 1), ("A", "X", P1, D, 2)])
    assert landing.one_publication(df, P1).count() == 1
    with pytest.raises(QualityError, match="found 2"):
        landing.one_publication(df)
    with pytest.raises(QualityError, match="no rows"):
        landing.one_publication(df, P2)
    text = df.select(*[F.col(c).cast("string") for c in df.columns]).filter("outputUsable < 1.5")
    assert dict(landing.one_publication(text).dtypes)["outputUsable"] == "decimal(12,3)"


def test_store_keeps_the_first_version_of_a_publication(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(NoPublications):
        store.read_store(spark, path)
    first = rows_of(spark, [("A", "X", P0, D, 1), ("B", "X", P0, D, 2)])
    assert [r["created"] for r in store.append_new_publications(first, path).collect()] == [True]
    again = rows_of(spark, [("A", "X", P0, D, 99), ("A", "X", P2, D, 3)])
    status = store.append_new_publications(again, path).orderBy("publishTime").collect()
    assert [r["created"] for r in status] == [False, True]
    outcome = store.append_new_publications(again, path).collect()
    assert [r["created"] for r in outcome] == [False, False]
    stored = store.read_store(spark, path)
    assert sorted(float(r["outputUsable"]) for r in stored.collect()) == [1.0, 2.0, 3.0]
    manifest = store.read_manifest(spark, path)
    assert manifest.count() == 2
    assert manifest.agg(F.sum("rows")).first()[0] == 3
    assert manifest.filter("distinct_units = 2 AND distinct_aliases = 0 AND columns = 8").count() == 1


def test_a_crashed_write_is_repaired_by_the_next_run(spark, tmp_path):
    """Data without a manifest entry is a publication that was not committed."""
    path = str(tmp_path / "store")
    df = rows_of(spark, [("A", "X", P0, D, 1), ("B", "X", P0, D, 2)])
    (
        df.limit(1)
        .withColumn("publish_date", F.to_date("publishTime"))
        .withColumn("publish_stamp", F.lit("20340921T000000Z"))
        .write.partitionBy("publish_date", "publish_stamp")
        .parquet(store.data_path(path))
    )
    store.append_new_publications(df, path)
    assert store.read_store(spark, path).count() == 2


def test_latest_publication_of_a_store_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "store")
    df = rows_of(spark, [("A", "X", t, D, 1) for t in (P0, P1, P2)])
    store.append_new_publications(df, path)
    latest = latest_publication(store.read_store(spark, path))
    assert latest.count() == 1
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publish_date" in plan
    ranged = landing.publish_range(store.read_store(spark, path), P0, P1)
    assert ranged.count() == 2
    assert "publish_date" in ranged._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_append_if_absent(spark, tmp_path):
    path = str(tmp_path / "raw")
    first = relational.raw_rows(rows_of(spark, [("A", "X", P0, D, 1)]))
    both = relational.raw_rows(
        rows_of(spark, [("A", "X", P0, D, 9), ("B", "X", P0, D, 9), ("A", "X", P1, D, 2)])
    )
    assert store.append_if_absent(spark, path, first, "publish_time").first()["status"] == "loaded"
    status = store.append_if_absent(spark, path, both, "publish_time").orderBy("publish_time").collect()
    assert [(r["status"], r["rows"]) for r in status] == [("already_loaded", 1), ("loaded", 1)]
    assert versions.read_version(spark, path).count() == 2


def test_upsert_replaces_and_adds_within_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "silver")
    keys = schema.RAW_KEY
    old = relational.raw_rows(
        rows_of(spark, [("A", "X", P0, D, 1), ("B", "X", P0, D, 2), ("A", "X", P2, D, 3)])
    )
    new = relational.raw_rows(rows_of(spark, [("A", "Y", P0, D, 10), ("C", "X", P1, D, 4)]))
    assert tables.upsert(spark, path, old, keys, "publish_time") == 3
    untouched = set((tmp_path / "silver" / "data" / "publish_date=2034-09-22").rglob("*.parquet"))
    for _ in range(2):
        assert tables.upsert(spark, path, new, keys, "publish_time") == 2
        rows = versions.read_version(spark, path).collect()
        assert sorted((r["national_grid_bm_unit"], float(r["output_usable_mw"])) for r in rows) == [
            ("A", 3.0), ("A", 10.0), ("B", 2.0), ("C", 4.0),
        ]
    assert set((tmp_path / "silver" / "data" / "publish_date=2034-09-22").rglob("*.parquet")) == untouched
    assert tables.upsert(spark, path, new.limit(0), keys, "publish_time") == 0
    with pytest.raises(ValueError, match="repeat"):
        tables.upsert(spark, path, new.unionByName(new), keys, "publish_time")


def test_merge_needs_a_row_level_table_format(spark):
    from pyspark.errors import PySparkException

    df = rows_of(spark, [("A", "X", P0, D, 1)])
    spark.sql("DROP TABLE IF EXISTS merge_target")
    df.write.saveAsTable("merge_target")
    with pytest.raises(PySparkException, match="MERGE INTO"):
        tables.merge_table(df, "merge_target", ["nationalGridBmUnit"])
    spark.sql("DROP TABLE merge_target")


def test_verify_load(spark):
    a = rows_of(spark, [("A", "X", P0, D, 1), ("A", "X", P1, D, 1)])
    b = rows_of(spark, [("A", "X", P0, D, 1), ("A", "X", P2, D, 1)])
    rows = tables.verify_load(a, b, "publishTime").orderBy("publishTime").collect()
    assert [(r["source_rows"], r["target_rows"], r["complete"]) for r in rows] == [
        (1, 1, True), (1, 0, False), (0, 1, False),
    ]


def test_read_dataset(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_dataset(spark, str(tmp_path / "absent"))
    with pytest.raises(FileNotFoundError):
        tables.read_dataset(spark, "absent_table")
    df = rows_of(spark, [("A", "X", P0, D, 1)])
    paths = tables.write_parquet({"one": df}, str(tmp_path))
    assert same_rows(tables.read_dataset(spark, paths["one"]), df)


def test_backfill_creates_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = rows_of(
        spark,
        [(u, f, t, D, mw) for t in (P0, P1) for u, f, mw in (("GORSE-3", "HYDRO", 100), ("TARN-8", "TIDE", 12))],
    )
    store.append_new_publications(df.filter(F.col("publishTime") == F.lit(P1)), path)
    summary = jobs.backfill(df, P0, P1, path).first().asDict()
    assert summary == {
        "rows_returned": 4, "publications_found": 2, "publications_created": 1, "publications_existing": 1,
    }
    assert set(jobs.backfill(df, "2020-01-01", "2020-01-02", path).first().asDict().values()) == {0}
    doubled = df.unionByName(df)
    # Stored publications are not judged again; new ones with repeated keys are refused.
    assert jobs.backfill(doubled, P0, P1, path).first()["publications_existing"] == 2
    with pytest.raises(QualityError):
        jobs.backfill(doubled, P0, P1, str(tmp_path / "other"))


def test_an_upsert_of_null_keys_is_idempotent(spark):
    schema = "unit string, day int, mw int"
    rows = spark.createDataFrame([(None, 1, 5), ("x", None, 6), (None, None, 7)], schema)
    once = tables.merged(rows.limit(0), rows, ["unit", "day"])
    assert same_rows(tables.merged(once, rows, ["unit", "day"]), rows)


def test_a_thousand_runs_leave_a_bounded_manifest(spark, tmp_path, monkeypatch):
    """Each run appends a file; checkpoints gather them, also after a compaction that died."""
    monkeypatch.setattr(store.compact_manifest, "__defaults__", (3,))
    path = str(tmp_path / "store")
    counts, died = [], False
    for n in range(14):
        df = rows_of(spark, [("GORSE-3", "HYDRO", utc("2034-09-21", n), D, n)])
        if n == 6:
            with monkeypatch.context() as patch:
                patch.setattr(store, "read_manifest", lambda *_: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    store.compact_manifest(spark, path, 0)
            died = True
        store.append_new_publications(df, path)
        manifest = store.read_manifest(spark, path)
        assert manifest.select("publishTime").distinct().count() == manifest.count() == n + 1
        counts.append(len(list((tmp_path / "store").glob("manifest*/**/*.parquet"))))
    assert died and max(counts) <= 2 * 4 + 2
    assert store.read_store(spark, path).count() == 14
    outcome = store.append_new_publications(rows_of(spark, [("GORSE-3", "HYDRO", utc("2034-09-21"), D, 99)]), path)
    assert [r["created"] for r in outcome.collect()] == [False]
    assert not store.compact_manifest(spark, path, 100)
