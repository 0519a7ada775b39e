"""Jobs, audit, gold and serving products."""

from __future__ import annotations

import json

import pytest
from conftest import rows_of, same_rows, utc
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vintager.columns import DEFAULT as C
from vintager.operators import pairs, publications, revisions
from vintager.operators.availability import availability, group_history
from vintager.operators.quality import QualityError
from vintager.plans import audit, gold, jobs, relational, serving
from vintager.sources import snapshots, store
from vintager.sources.versions import read_version
from vintager.workload import pipeline_runs

P0, P1 = utc("2031-03-05", 6), utc("2031-03-05", 7)
D, D2 = "2031-03-09", "2031-03-11"
# (unit, fuel, date) and its measure in both publications; one is missing in each.
TABLE = {
    ("K7", "HYDRO", D): ("40.5", "31.25"), ("K7", "HYDRO", D2): ("40.5", "40.5"),
    ("M2", "HYDRO", D): ("12", None), ("T90", "COAL", D): (None, "7"), ("V4", "COAL", D2): ("0", "2.5"),
}
BOTH = [key for key, pair in TABLE.items() if None not in pair]
CELLS = {(time, fuel, day) for (_, fuel, day), pair in TABLE.items() for time, mw in enumerate(pair) if mw}
DAYS = {(time, day) for time, _, day in CELLS}


def pairs_of(cells):
    """Series that both publications have."""
    return len({cell[1:] for cell in cells if cell[0] == 0} & {cell[1:] for cell in cells if cell[0]})


EXPECTED = {
    "fuel_availability_history": len(CELLS),
    "system_availability_history": len(DAYS),
    "unit_revision_history": len(BOTH),
    "fuel_revision_history": pairs_of(CELLS),
    "system_revision_history": pairs_of(DAYS),
}
CHANGED = sum(TABLE[key][0] != TABLE[key][1] for key in BOTH)


@pytest.fixture
def small(spark):
    return rows_of(
        spark,
        [
            (unit, fuel, time, day, pair[i])
            for (unit, fuel, day), pair in TABLE.items()
            for i, time in enumerate((P0, P1))
            if pair[i] is not None
        ],
    )


def test_five_datasets(small):
    assert {n: df.count() for n, df in jobs.build_datasets(small).items()} == EXPECTED


def test_parquet_job_is_idempotent(spark, small, tmp_path):
    files = str(tmp_path / "snapshots")
    small.coalesce(1).write.parquet(files)
    sink = jobs.ParquetSink(str(tmp_path / "out"))
    for _ in range(2):
        result = jobs.run_history_job(spark, small, sink)
        assert result["row_counts"] == EXPECTED
        assert result["quality"]["publications"] == 2
    for name, df in jobs.build_datasets(small).items():
        assert same_rows(sink.read(spark, name), df)


def test_table_job_replaces_the_schema(spark, small):
    spark.sql("CREATE DATABASE IF NOT EXISTS serving")
    spark.range(1).write.mode("overwrite").saveAsTable("serving.fuel_availability_history")
    sink = jobs.TableSink("serving")
    for _ in range(2):
        assert jobs.run_history_job(spark, small, sink)["row_counts"] == EXPECTED
    assert spark.table("serving.unit_revision_history").count() == len(BOTH)


def test_dated_tables_prune_the_trailing_window(spark, canon, tmp_path):
    sink = jobs.ParquetSink(str(tmp_path), by_date=True)
    jobs.run_history_job(spark, canon, sink)
    table = sink.read(spark, "unit_revision_history")
    windowed = publications.trailing(table, 24)
    windowed.collect()
    plan = windowed._jdf.queryExecution().executedPlan().toString()
    assert "publish_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert same_rows(windowed.drop("publish_date"), revisions.recent_entity_revisions(canon))
    assert set(table.columns) - {"publish_date"} == set(revisions.entity_revisions(canon).columns)


def test_bad_history_stops_the_job(spark, small, tmp_path):
    with pytest.raises(QualityError):
        jobs.run_history_job(spark, small.unionByName(small), jobs.ParquetSink(str(tmp_path)))


def test_history_report(small):
    report = jobs.history_report(small)
    assert {r["dataset"]: r["rows"] for r in report["row_counts"].collect()} == EXPECTED
    assert report["changed_rows"].first()["changedRows"] == CHANGED


def test_replay_loads_everything_and_twice_changes_nothing(spark, small, tmp_path):
    targets = jobs.RelationalTargets(str(tmp_path))
    for status in ("loaded", "already_loaded"):
        result = jobs.replay(small, targets)
        assert {r["status"] for r in result["raw"].collect()} == {status}
        assert (result["unit_rows"], result["system_rows"]) == (len(BOTH), 2)
        assert [r["changedRows"] for r in result["revision_pairs"].collect()] == [CHANGED]
        loaded = result["availability"].collect()
        assert sum(r["fuel_rows"] for r in loaded) == len(CELLS)
        assert sum(r["system_rows"] for r in loaded) == len(DAYS)
    assert read_version(spark, targets.unit_revision).count() == len(BOTH)
    assert read_version(spark, targets.raw).count() == small.count()


def test_availability_load_guards(spark, small, tmp_path):
    targets = jobs.RelationalTargets(str(tmp_path))
    fuel, system = availability(small, [C.group]), availability(small)
    with pytest.raises(QualityError, match="Group"):
        jobs.load_availability(spark, fuel.limit(0), system, targets)
    with pytest.raises(QualityError, match="System"):
        jobs.load_availability(spark, fuel, system.limit(0), targets)
    one = system.filter(F.col("publishTime") == F.lit(P0))
    with pytest.raises(QualityError, match="different"):
        jobs.load_availability(spark, fuel, one, targets)


def land(folder, name, published, mw):
    rows = [
        {"dataset": "TEST", "fuelType": "CCGT", "nationalGridBmUnit": unit, "bmUnit": None,
         "publishTime": published, "forecastDate": D, "outputUsable": value}
        for unit, value in mw.items()
    ]
    (folder / name).write_text(json.dumps(rows))


def test_governed_run(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    targets = jobs.RelationalTargets(str(tmp_path / "db"))
    log, base = str(tmp_path / "log"), str(tmp_path / "store")
    stages = jobs.standard_stages(spark, str(folder), base, str(tmp_path / "work"), targets)
    assert len(stages) == 6

    land(folder, "a.json", "2031-03-05T00:00:00Z", {"A": 100, "B": 50})
    first = jobs.governed_run(spark, stages, log, "run", "TEST")
    assert first["revision load"] is None and first["rows"] == 2
    land(folder, "b.json", "2031-03-05T01:00:00Z", {"A": 120, "B": 50})
    second = jobs.governed_run(spark, stages, log, "run", "TEST")
    assert second["revision load"]["unit_rows"] == 2
    assert read_version(spark, targets.system_revision).first()["revision_mw"] == 20

    def broken(context):
        raise RuntimeError("no disk")

    with pytest.raises(RuntimeError):
        jobs.governed_run(spark, [("ingestion", lambda c: None), ("raw load", broken)], log, "run", "TEST")
    state = audit.audit_state(spark.read.parquet(log)).orderBy("pipeline_run_id").collect()
    assert [r["status"] for r in state] == ["SUCCEEDED", "SUCCEEDED", "FAILED"]
    assert [r["rows_processed"] for r in state] == [2, 2, None]
    assert state[2]["error_message"] == "Stage 'raw load' failed: no disk"
    assert state[0]["pipeline_run_id"] == first["run_id"]
    assert all(r["completed_at"] >= r["started_at"] for r in state)


def test_collect_and_run(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    land(folder, "a.json", "2031-03-05T00:00:00Z", {"A": 100, "B": 50})
    land(folder, "b.json", "2031-03-05T01:00:00Z", {"A": 120, "B": 50})
    result = jobs.collect_and_run(
        spark, str(folder), str(tmp_path / "store"), jobs.ParquetSink(str(tmp_path / "out"))
    )
    assert result["row_counts"]["unit_revision_history"] == 2
    assert result["ingested"].filter("created").count() == 2


def test_audit_failure_keeps_the_known_publication_and_clips_the_message(spark, tmp_path):
    log = str(tmp_path / "log")
    run = audit.audit_start(spark, log, "run", "TEST")
    running = audit.audit_state(spark.read.parquet(log)).first()
    assert running["status"] == "RUNNING" and running["completed_at"] is None
    audit.audit_fail(spark, log, run, "x" * 6000, P0)
    audit.audit_fail(spark, log, run, "again")
    state = audit.audit_state(spark.read.parquet(log)).first()
    assert state["error_message"] == "again" and state["source_publish_time"] is not None
    assert spark.read.parquet(log).agg(F.max(F.length("error_message"))).first()[0] == 5000
    audit.audit_complete(spark, log, run, P1, 7)
    state = audit.audit_state(spark.read.parquet(log)).first()
    assert (state["status"], state["rows_processed"], state["error_message"]) == ("SUCCEEDED", 7, None)


def gold_tables(canon):
    unit = relational.unit_revisions(pairs.latest_pair_revisions(canon))
    changed = gold.latest_changed_units(unit)
    system = relational.system_revisions(pairs.rollup_pair(pairs.latest_pair_revisions(canon)))
    outlook = gold.availability_outlook(relational.group_availability(availability(canon, [C.group])))
    return outlook, changed, system, gold.pipeline_health(pipeline_runs(canon))


def test_dashboard_has_no_row_without_a_run_or_revision(canon):
    outlook, changed, system, health = gold_tables(canon)
    assert gold.dashboard_kpis(outlook, changed, system, health).count() == 1
    assert gold.dashboard_kpis(outlook, changed, system, health.limit(0)).isEmpty()
    assert gold.dashboard_kpis(outlook, changed, system.limit(0), health).isEmpty()
    assert gold.dashboard_kpis(outlook.limit(0), changed, system, health).isEmpty()
    assert gold.dashboard_kpis(outlook, changed.limit(0), system, health).first()["changed_unit_rows"] == 0


def test_top_ranked_units_are_the_head_of_the_ranking(canon):
    _, changed, _, _ = gold_tables(canon)
    full = gold.unit_revision_ranking(changed).filter("revision_rank <= 2")
    top = gold.top_ranked_units(changed, 2).withColumn("revision_rank", F.col("revision_rank").cast("bigint"))
    assert same_rows(top, full)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_no_product_needs_a_cross_join(spark, canon):
    import __spark_entry__ as entry

    for key in ("q_dashboard_kpis", "q_kpis", "q_stability", "q_revision_signals", "q_fuel_mix_top7"):
        plan = entry.queries()[key](spark, "/root/testdata/sf0.001")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key


def test_mix_of_zero_availability(spark):
    df = rows_of(spark, [("U", "X", P0, D, 0), ("V", "INTX", P0, D, 0)])
    outlook = gold.availability_outlook(relational.group_availability(availability(df, [C.group])))
    assert gold.availability_mix(outlook).first()["interconnector_pct"] is None
    mix = serving.group_mix(group_history(df)).collect()
    assert [float(r["share_pct"]) for r in mix] == [0.0, 0.0]
    assert {r["fuel_label"] for r in mix} == {"X (X)", "INTX (INTX)"}


def test_stability_without_movement_and_without_history(spark):
    df = rows_of(spark, [("U", "WIND", P0, D, 5), ("U", "WIND", P1, D, 5)])
    unit = revisions.entity_revisions(df)
    fuel = revisions.series_revisions(group_history(df), C.group_series)
    row = serving.stability(unit, unit, fuel).first()
    assert (float(row["stability_score"]), row["stability_band"]) == (100.0, "Highly stable")
    assert (row["watch_status"], row["most_revised_fuel"]) == ("BALANCED", "Unavailable")
    assert float(row["most_revised_fuel_abs_mw"]) == 0.0
    empty = unit.limit(0)
    with pytest.raises(PySparkException, match="empty"):
        serving.stability(empty, empty, fuel.limit(0)).collect()


def test_shares_of_directions_sum_to_hundred(canon):
    shares = serving.direction_counts(revisions.entity_revisions(canon))
    assert abs(float(shares.agg(F.sum("share_pct")).first()[0]) - 100) < 0.02


def test_signals_are_null_when_nothing_moved(spark):
    df = rows_of(spark, [("U", "WIND", P0, D, 5), ("U", "WIND", P1, D, 5)])
    row = serving.revision_signals(revisions.recent_entity_revisions(df)).first()
    assert row["latest_publication"] is not None
    assert row["largest_upward"] is None and row["most_revised_fuel"] is None


def test_snapshot_directory_feeds_the_job(spark, small, tmp_path):
    pdf = small.toPandas()
    pdf["outputUsable"] = pdf["outputUsable"].astype(float)
    for stamp, part in pdf.groupby("publishTime"):
        part.to_parquet(
            tmp_path / f"x_publish_{stamp:%Y%m%dT%H%M%SZ}.parquet", index=False, coerce_timestamps="us"
        )
    result = jobs.run_history_job(spark, str(tmp_path), jobs.ParquetSink(str(tmp_path / "out")))
    assert result["row_counts"] == EXPECTED
    assert snapshots.list_snapshots(spark, str(tmp_path)).count() == 2


def test_store_rows_give_the_same_datasets(spark, canon, tmp_path):
    path = str(tmp_path / "store")
    store.append_new_publications(canon, path)
    stored = store.read_store(spark, path)
    for name, df in jobs.build_datasets(stored.drop("publish_date")).items():
        assert same_rows(df, jobs.build_datasets(canon)[name]), name
    recent = revisions.recent_entity_revisions(stored).drop("publish_date")
    assert same_rows(recent, revisions.recent_entity_revisions(canon))
