"""Incremental ingest and incremental revisions equal the batch results."""

from __future__ import annotations

import json

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from vintager.columns import PUBLISH_DATE
from vintager.operators.revisions import entity_revisions
from vintager.sources import store
from vintager.sources.versions import read_version
from vintager.streaming.publications import ingest_stream


def write_publication(folder, name, hour, mw, targets=("2034-09-25",)):
    rows = [
        {"dataset": "TEST", "fuelType": fuel, "nationalGridBmUnit": unit, "bmUnit": None,
         "publishTime": f"2034-09-{21 + hour // 24:02d}T{hour % 24:02d}:00:00Z",
         "forecastDate": target, "outputUsable": value}
        for target in targets
        for unit, (fuel, value) in mw.items()
    ]
    (folder / name).write_text(json.dumps(rows))


@pytest.fixture
def paths(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    return folder, str(tmp_path / "store"), str(tmp_path / "checkpoint"), str(tmp_path / "revisions")


def assert_current(spark, base, table):
    stored = store.read_store(spark, base).drop(PUBLISH_DATE)
    incremental = read_version(spark, table).drop(PUBLISH_DATE)
    assert same_rows(incremental, entity_revisions(stored))


def test_only_new_files_are_ingested(spark, paths):
    folder, base, checkpoint, _ = paths
    write_publication(folder, "a.json", 0, {"A": ("X", 1)})
    ingest_stream(spark, str(folder), base, checkpoint)
    write_publication(folder, "b.json", 1, {"A": ("X", 2)})
    write_publication(folder, "c.json", 0, {"A": ("X", 99)})
    query = ingest_stream(spark, str(folder), base, checkpoint)
    assert query.lastProgress["numInputRows"] == 2
    rows = store.read_store(spark, base).orderBy("publishTime").collect()
    assert [float(r["outputUsable"]) for r in rows] == [1.0, 2.0]


@pytest.mark.parametrize("order", [[0, 1, 2, 30], [30, 1, 0, 2]])
def test_any_arrival_order_gives_the_batch_revisions(spark, paths, order):
    folder, base, checkpoint, table = paths
    values = {
        0: {"A": ("X", 10), "B": ("Y", 5)},
        1: {"A": ("X", 12)},
        2: {"A": ("Z", 12), "B": ("Y", 0)},
        30: {"A": ("X", 7), "B": ("Y", 9), "C": ("Y", 1)},
    }
    for hour in order:
        write_publication(folder, f"{hour}.json", hour, values[hour], ("2034-09-25", "2034-09-26"))
        ingest_stream(spark, str(folder), base, checkpoint, revisions=table)
    assert_current(spark, base, table)
    changed = read_version(spark, table)
    assert changed.filter(F.col("previousPublishTime") >= F.col("latestPublishTime")).isEmpty()
    assert changed.count() == 10


def test_a_replayed_batch_changes_nothing(spark, paths, tmp_path):
    folder, base, checkpoint, table = paths
    for hour in (0, 1):
        write_publication(folder, f"{hour}.json", hour, {"A": ("X", hour)})
    ingest_stream(spark, str(folder), base, checkpoint, revisions=table)
    ingest_stream(spark, str(folder), base, str(tmp_path / "other"), revisions=table)
    assert store.read_store(spark, base).count() == 2
    assert_current(spark, base, table)


def test_a_publication_pulled_again_is_no_error(spark, paths):
    from vintager.plans.jobs import ingest_landing

    folder, base, checkpoint, _ = paths
    write_publication(folder, "a.json", 0, {"A": ("X", 1)})
    ingest_landing(spark, str(folder), base)
    write_publication(folder, "b.json", 0, {"A": ("X", 8)})
    assert [r["created"] for r in ingest_landing(spark, str(folder), base).collect()] == [False]
    ingest_stream(spark, str(folder), base, checkpoint)
    assert [float(r["outputUsable"]) for r in store.read_store(spark, base).collect()] == [1.0]


def test_a_bad_publication_leaves_the_range_to_the_others(spark, paths):
    from vintager.operators.quality import QualityError
    from vintager.plans.jobs import backfill
    from vintager.sources.landing import read_landing

    folder, base, _, _ = paths
    write_publication(folder, "a.json", 3, {"A": ("X", 1)})
    write_publication(folder, "b.json", 4, {"A": ("X", 2)}, ("2034-09-25", "2034-09-25"))
    rows = read_landing(spark, str(folder))
    with pytest.raises(QualityError, match="2 rows share a source key.*04:00:00"):
        backfill(rows, "2034-09-21T00:00:00Z", "2034-09-22T00:00:00Z", base)
    assert [float(r["outputUsable"]) for r in store.read_store(spark, base).collect()] == [1.0]


def quarantined(spark, base):
    rows = store.read_quarantine(spark, base).orderBy("publishTime").collect()
    return [(r["publishTime"].hour, r["rows"], r["reason"]) for r in rows]


def test_a_bad_publication_does_not_stop_the_stream(spark, paths):
    """It is named once, its rows are kept aside, and later runs pass it over."""
    folder, base, checkpoint, table = paths
    write_publication(folder, "a.json", 3, {"G5": ("PEAT", 1)}, ("2034-09-25", "2034-09-25"))
    write_publication(folder, "b.json", 4, {"G5": ("PEAT", 2)})
    for n in range(2):
        ingest_stream(spark, str(folder), base, checkpoint, revisions=table, files_per_batch=1)
        assert quarantined(spark, base) == [(3, 2, "2 rows share a source key")]
        assert store.read_store(spark, base).count() == n + 1
        write_publication(folder, f"c{n}.json", 5 + n, {"G5": ("PEAT", 3 + n)})
    assert spark.read.parquet(store.quarantine_ledger_path(base)).count() == 1
    letters = store.read_quarantine(spark, base).first()["dead_letters"]
    assert spark.read.parquet(letters).count() == 2
    ingest_stream(spark, str(folder), base, checkpoint, revisions=table)
    assert_current(spark, base, table)


def test_only_bad_publications(spark, paths):
    folder, base, checkpoint, table = paths
    write_publication(folder, "a.json", 3, {"G5": ("PEAT", 1)}, ("2034-09-25", "2034-09-25"))
    ingest_stream(spark, str(folder), base, checkpoint, revisions=table)
    assert len(quarantined(spark, base)) == 1
    with pytest.raises(store.NoPublications):
        store.read_store(spark, base)


def test_batch_ingest_judges_each_publication_alone(spark, paths):
    from vintager.operators.quality import QualityError
    from vintager.plans.jobs import ingest_landing

    folder, base, _, _ = paths
    empty = folder / "empty"
    empty.mkdir()
    (empty / "none.json").write_text("[]")
    with pytest.raises(QualityError, match="no rows"):
        ingest_landing(spark, str(empty), base)
    (empty / "none.json").unlink()
    empty.rmdir()
    write_publication(folder, "a.json", 3, {"G5": ("PEAT", 1), "L2": ("TIDE", 0.5)})
    write_publication(folder, "b.json", 4, {"G5": ("PEAT", 2)}, ("2034-09-25", "2034-09-25"))
    (folder / "c.json").write_text(json.dumps([
        {"nationalGridBmUnit": "G5", "publishTime": "soon", "forecastDate": "2034-09-25"}
    ]))

    def outcome():
        rows = ingest_landing(spark, str(folder), base).collect()
        return {(r["publishTime"] and r["publishTime"].hour, r["rows"], r["status"], r["created"]) for r in rows}

    undated = (None, 1, "rejected", False)
    assert outcome() == {(3, 2, "created", True), (4, 2, "rejected", False), undated}
    assert outcome() == {(3, 2, "existing", False), (4, 2, "quarantined", False), undated}
    assert store.read_store(spark, base).count() == 2
    # Released and corrected, the publication is judged anew.
    write_publication(folder, "b.json", 4, {"G5": ("PEAT", 2)})
    assert (4, 1, "quarantined", False) in outcome()
    store.release(spark, base, store.read_quarantine(spark, base))
    assert quarantined(spark, base) == []
    assert (4, 1, "created", True) in outcome()
    assert store.read_store(spark, base).count() == 3


def test_a_run_that_died_before_the_ledger_is_repeated(spark, paths, monkeypatch):
    """Dead letters without a ledger line are written again, once."""
    from vintager.plans.jobs import ingest_landing

    folder, base, _, _ = paths
    write_publication(folder, "b.json", 4, {"G5": ("PEAT", 2)}, ("2034-09-25", "2034-09-25"))

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_record", die)
        with pytest.raises(OSError, match="lost"):
            ingest_landing(spark, str(folder), base)
    assert quarantined(spark, base) == []
    ingest_landing(spark, str(folder), base)
    assert quarantined(spark, base) == [(4, 2, "2 rows share a source key")]
    assert spark.read.parquet(store.quarantine_rows_path(base)).count() == 2


def test_incremental_revisions_keep_null_units_and_dates(spark):
    from conftest import rows_of, same_rows, utc

    from vintager.operators.revisions import entity_revisions
    from vintager.streaming.publications import affected_revisions

    first, second = utc("2031-03-05", 6), utc("2031-03-05", 7)
    keys = [(None, "PEAT", "2031-03-09"), ("K7", "PEAT", None), ("K7", "PEAT", "2031-03-09")]
    history = rows_of(
        spark, [(u, f, t, d, i + (t == second)) for i, (u, f, d) in enumerate(keys) for t in (first, second)]
    )
    times = history.filter("publishTime = timestamp'2031-03-05 07:00:00'").select("publishTime").distinct()
    assert same_rows(affected_revisions(history, times), entity_revisions(history.select(*affected_revisions.__defaults__[0].required)))


def test_split_publications_are_whole_for_any_files_per_batch(spark, tmp_path):
    """One publication lies in three files, which share a key; the first file's row stays."""
    import os

    from vintager.plans.jobs import ingest_landing

    folder = tmp_path / "split"
    folder.mkdir()
    write_publication(folder, "p.json", 5, {"H3": ("TIDE", 21), "H8": ("TIDE", 4)})
    write_publication(folder, "q.json", 5, {"H8": ("TIDE", 77), "L2": ("PEAT", 6)})
    write_publication(folder, "r.json", 5, {"N1": ("PEAT", 9)}, ("2034-09-26",))
    write_publication(folder, "s.json", 8, {"H3": ("TIDE", 30)})
    for place, name in enumerate("pqrs"):
        os.utime(folder / f"{name}.json", (1_700_000_000 + place,) * 2)
    want = [("H3", 5, 21.0), ("H3", 8, 30.0), ("H8", 5, 4.0), ("L2", 5, 6.0), ("N1", 5, 9.0)]

    def found(base):
        rows = store.read_store(spark, base).collect()
        return sorted((r["nationalGridBmUnit"], r["publishTime"].hour, float(r["outputUsable"])) for r in rows)

    for n in (1, 2, 1000):
        base, table = str(tmp_path / f"store{n}"), str(tmp_path / f"revisions{n}")
        ingest_stream(
            spark, str(folder), base, str(tmp_path / f"checkpoint{n}"), revisions=table, files_per_batch=n
        )
        assert found(base) == want
        assert_current(spark, base, table)
        assert not (tmp_path / f"checkpoint{n}-staged").exists()
    base = str(tmp_path / "batch")
    outcome = ingest_landing(spark, str(folder), base).collect()
    assert sorted((r["rows"], r["created"]) for r in outcome) == [(1, True), (4, True)]
    assert found(base) == want
    again = ingest_landing(spark, str(folder), base).collect()
    assert not any(r["created"] for r in again)
