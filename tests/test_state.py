"""Stored revisions equal what the whole history gives, and serving reads their last days."""

from __future__ import annotations

import re

import pytest
from conftest import rows_of, same_rows, utc
from pyspark.sql import functions as F

from vintager.columns import DEFAULT as C
from vintager.columns import PUBLISH_DATE
from vintager.operators import publications, revisions
from vintager.operators.availability import group_history
from vintager.plans import serving, state
from vintager.sources import tables, versions

# unit, fuel, publication (day of May, hour), target, MW; a unit changes its fuel, one is unknown.
CELLS = [
    ("R1", "SOLAR", (3, 5), "2035-05-20", "10.5"), ("R1", "SOLAR", (3, 17), "2035-05-20", "12.25"),
    ("R1", "TIDE", (4, 5), "2035-05-20", "12.25"), ("R1", "TIDE", (6, 5), "2035-05-20", "3"),
    ("R2", "TIDE", (3, 5), "2035-05-20", "7"), ("R2", "TIDE", (6, 5), "2035-05-20", None),
    ("R2", "TIDE", (6, 17), "2035-05-20", "7.125"), ("R3", None, (3, 17), "2035-05-21", "1"),
    ("R3", None, (4, 5), "2035-05-21", "0"), (None, "PEAT", (4, 5), "2035-05-21", "4"),
    (None, "PEAT", (6, 17), "2035-05-21", "4"), ("R4", "PEAT", (6, 17), "2035-05-22", "9"),
]


@pytest.fixture
def history(spark):
    at = lambda day, hour: utc(f"2035-05-{day:02d}", hour)
    return rows_of(spark, [(u, f, at(*t), d, mw) for u, f, t, d, mw in CELLS]).persist()


def arrive(spark, root, history, batches):
    """Refresh with the publications of each batch in turn; a publication is its number in time."""
    kept = state.RevisionState(root)
    times = [r[0] for r in history.select("publishTime").distinct().orderBy("publishTime").collect()]
    seen = []
    for batch in batches:
        seen += batch
        so_far = history.filter(F.col("publishTime").isin([times[i] for i in seen]))
        new = history.filter(F.col("publishTime").isin([times[i] for i in batch]))
        state.refresh(spark, kept, so_far, publications.publications(new))
    return kept


@pytest.mark.parametrize("batches", [[[0, 1, 2, 3, 4]], [[4, 0], [1, 3], [1, 3, 2]]])
def test_any_arrival_order_gives_the_products_of_the_history(spark, history, tmp_path, batches):
    kept = arrive(spark, str(tmp_path), history, batches)
    units = revisions.entity_revisions(history)
    groups = revisions.series_revisions(group_history(history), C.group_series)
    assert same_rows(versions.read_version(spark, kept.units).drop(PUBLISH_DATE), units)
    assert same_rows(versions.read_version(spark, kept.groups).drop(PUBLISH_DATE), groups)
    assert same_rows(state.direction_counts(spark, kept), serving.direction_counts(units))
    for hours in (24, 60):
        window = publications.trailing(units, hours)
        assert same_rows(state.recent(spark, kept.units, hours), window)
        wanted = serving.stability(units, window, publications.trailing(groups, hours))
        assert state.stability(spark, kept, hours).collect() == wanted.collect()


def test_serving_reads_the_last_days_only(spark, canon, tmp_path):
    kept = state.RevisionState(str(tmp_path))
    state.refresh(spark, kept, canon, publications.publications(canon))

    def days(df):
        return {re.search("publish_date=([^/]+)", name)[1] for name in df.inputFiles()}

    stored = sorted(versions.version(spark, kept.units).live)
    assert len(stored) > 20
    assert days(state.recent(spark, kept.units)) == set(stored[-2:])
    assert days(state.recent(spark, kept.groups)) == set(stored[-2:])
    scans = state.stability(spark, kept)._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("Relation [") >= 3
    # Units and groups: the window and its end; the lines of the dates once.
    assert all(kept.days in name for name in state.direction_counts(spark, kept).inputFiles())
    read = state.stability(spark, kept).inputFiles()
    assert {name for name in days(state.recent(spark, kept.units))} >= {
        re.search("publish_date=([^/]+)", name)[1] for name in read if kept.days not in name
    }


def test_a_refresh_that_died_is_finished_by_the_next(spark, history, tmp_path, monkeypatch):
    kept = arrive(spark, str(tmp_path), history, [[0, 1]])
    calls = []
    real = tables.upsert

    def dying(*arguments):
        calls.append(arguments)
        if len(calls) == 2:
            raise OSError("lost")
        return real(*arguments)

    times = publications.publications(history)
    with monkeypatch.context() as patch:
        patch.setattr(state, "upsert", dying)
        with pytest.raises(OSError, match="lost"):
            state.refresh(spark, kept, history, times)
    state.refresh(spark, kept, history, times)
    units = revisions.entity_revisions(history)
    assert same_rows(versions.read_version(spark, kept.units).drop(PUBLISH_DATE), units)
    assert same_rows(state.direction_counts(spark, kept), serving.direction_counts(units))


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="No revisions"):
        state.recent(spark, str(tmp_path / "absent"))
