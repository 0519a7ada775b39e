"""Revisions between adjacent publications."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import rows_of, same_rows, utc
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vintager.columns import DEFAULT as C
from vintager.operators import pairs
from vintager.operators.availability import availability
from vintager.operators.quality import reconcile_availability, reconcile_revisions
from vintager.plans import jobs
from vintager.workload import dirty

P0, P1 = utc("2031-03-05", 6), utc("2031-03-05", 7)
D, D2 = "2031-03-09", "2031-03-11"
# Fractional measures; R1 leaves and S3 arrives; one row has neither unit nor fuel.
BEFORE = {"K7": ("HYDRO", "40.5"), "M2": ("HYDRO", "12.25"), "T90": ("COAL", "7"),
          "V4": ("COAL", "0"), "R1": ("GAS", "3"), None: (None, "1.125")}
AFTER = {"K7": ("HYDRO", "31.25"), "M2": ("HYDRO", "12.25"), "T90": ("COAL", "0"),
         "V4": ("COAL", "2.5"), "S3": ("GAS", "9"), None: (None, "1.5")}
MATCHED = [unit for unit in BEFORE if unit in AFTER]


def moved(unit):
    return Decimal(AFTER[unit][1]) - Decimal(BEFORE[unit][1])


@pytest.fixture
def two(spark):
    return tuple(
        rows_of(spark, [(unit, fuel, time, D, mw) for unit, (fuel, mw) in rows.items()])
        for time, rows in ((P0, BEFORE), (P1, AFTER))
    )


def test_matched_units_and_only_those_are_compared(two):
    rows = {r["nationalGridBmUnit"]: r for r in pairs.pair_revisions(*two).collect()}
    assert set(rows) == set(MATCHED)
    for unit, row in rows.items():
        change = moved(unit)
        assert row["revisionMW"] == change and row["absoluteRevisionMW"] == abs(change)
        assert row["changeDirection"] == ("UP" if change > 0 else "DOWN" if change else "UNCHANGED")
        before, after = (Decimal(side[unit][1]) for side in (BEFORE, AFTER))
        assert row["becameUnavailable"] == (before > 0 and after == 0)
        assert row["returnedAvailable"] == (before == 0 and after > 0)


def test_rollups_sum_the_matched_units(two):
    unit = pairs.pair_revisions(*two)
    groups = {r["fuelType"]: r for r in pairs.rollup_pair(unit, [C.group]).collect()}
    assert set(groups) == {"HYDRO", "COAL"}  # no fuel, no group
    for fuel, row in groups.items():
        members = [u for u in MATCHED if BEFORE[u][0] == fuel]
        assert row["revisionMW"] == sum(map(moved, members))
        assert row["changedUnits"] == sum(moved(u) != 0 for u in members)
    coal, system = groups["COAL"], pairs.rollup_pair(unit).first()
    assert (coal["becameUnavailableUnits"], coal["returnedAvailableUnits"]) == (1, 1)
    assert system["revisionMW"] == sum(map(moved, MATCHED)) == Decimal("-13.375")
    assert system["previousAvailableMW"] + system["revisionMW"] == system["latestAvailableMW"]


def test_levels_reconcile(canon):
    unit = pairs.all_pair_revisions(canon)
    sums = reconcile_revisions(unit, pairs.rollup_pair(unit, [C.group]), pairs.rollup_pair(unit))
    assert sums.count() == 57
    assert sums.filter(
        "unitRevisionMW <> fuelRevisionMW OR unitRevisionMW <> systemRevisionMW"
    ).isEmpty()


def test_no_common_dates_is_an_error(two):
    previous, latest = two
    moved = latest.withColumn("forecastDate", F.lit("2031-04-01").cast("date"))
    with pytest.raises(pairs.NoCommonDates):
        pairs.pair_revisions(previous, moved)
    assert pairs.match_publications(previous, moved).isEmpty()


def test_a_repeated_key_is_an_error(two):
    previous, latest = two
    with pytest.raises(PySparkException, match="not unique"):
        pairs.pair_revisions(previous.unionByName(previous), latest).collect()
    both = previous.unionByName(latest).unionByName(latest)
    with pytest.raises(PySparkException, match="not unique"):
        pairs.all_pair_revisions(both).collect()


def test_a_repeated_key_outside_the_common_dates_is_not(spark, two):
    previous, latest = two
    elsewhere = rows_of(spark, [("K7", "HYDRO", P0, "2031-02-01", 1)] * 2)
    assert pairs.pair_revisions(previous.unionByName(elsewhere), latest).count() == len(MATCHED)


def test_fuel_change_and_skipped_publication_drop_the_row(spark):
    p2 = utc("2031-03-05", 8)
    df = rows_of(
        spark,
        [
            ("CHANGES", "CCGT", P0, D, 10),
            ("SKIPS", "CCGT", P0, D, 10),
            ("CHANGES", "OCGT", P1, D, 20),
            ("STAYS", "CCGT", P1, D, 5),
            ("SKIPS", "CCGT", p2, D, 30),
            ("STAYS", "CCGT", p2, D, 6),
        ],
    )
    rows = pairs.all_pair_revisions(df).collect()
    assert [r["nationalGridBmUnit"] for r in rows] == ["STAYS"]


def test_null_fuel_matches_null_fuel(spark):
    df = rows_of(spark, [("U", None, P0, D, 10), ("U", None, P1, D, None)])
    unit = pairs.all_pair_revisions(df)
    row = unit.first()
    assert row["revisionMW"] is None and row["changeDirection"] == "UNCHANGED"
    assert not row["becameUnavailable"] and not row["returnedAvailable"]
    assert pairs.rollup_pair(unit, [C.group]).isEmpty()
    system = pairs.rollup_pair(unit).first()
    assert (system["changedUnits"], system["latestAvailableMW"], system["revisionMW"]) == (1, 0, 0)


def test_adjacent_pairs(spark):
    times = [utc("2026-08-11", 23), utc("2026-08-12", 0), utc("2026-08-12", 1)]
    df = rows_of(spark, [("U", "X", t, D, mw) for t, mw in zip(times, (100, 110, 90))])
    changed = pairs.changed_rows_by_adjacent_pair(pairs.all_pair_revisions(df)).collect()
    assert [r["changedRows"] for r in changed] == [1, 1]


@pytest.mark.parametrize("chunk", ["MONTH", "DAY", "HOUR"])
def test_chunks_do_not_change_pairs(canon, chunk):
    df = dirty(canon)
    assert same_rows(pairs.all_pair_revisions(df, chunk=None), pairs.all_pair_revisions(df, chunk=chunk))


def test_all_pairs_equal_each_pair_alone(canon):
    times = [r[0] for r in canon.select("publishTime").distinct().orderBy("publishTime").collect()]
    published = F.col("publishTime")
    whole = pairs.all_pair_revisions(canon)
    for before, after in list(zip(times, times[1:]))[::20]:
        alone = pairs.match_publications(
            canon.filter(published == before), canon.filter(published == after)
        )
        assert same_rows(alone, whole.filter(F.col("latestPublishTime") == after))


def test_overlap_counts_pairs_without_common_dates(spark):
    p2 = utc("2031-03-05", 8)
    df = rows_of(
        spark,
        [("U", "X", P0, D, 1), ("U", "X", P1, D, 1), ("U", "X", p2, "2031-03-30", 1)],
    )
    overlap = pairs.pair_overlap(df).orderBy("latestPublishTime").collect()
    assert [r["commonDates"] for r in overlap] == [1, 0]


def test_top_movers(two):
    unit = pairs.pair_revisions(*two)
    assert [r["nationalGridBmUnit"] for r in pairs.top_pair_movers(unit, False).collect()] == ["K7", "T90"]
    assert [r["nationalGridBmUnit"] for r in pairs.top_pair_movers(unit, True).collect()] == ["V4", None]


def test_latest_pair_job(spark, two, tmp_path):
    previous, latest = two
    assert jobs.latest_pair_job(previous) == {"status": "waiting"}
    built = jobs.latest_pair_job(previous.unionByName(latest), str(tmp_path))
    assert built["status"] == "built"
    assert built["latest_unit_revisions"].count() == len(MATCHED)
    assert spark.read.parquet(f"{tmp_path}/latest_system_revisions").first()["revisionMW"] == Decimal("-13.375")
    assert built["top_upward"].count() == 2


def test_availability(spark):
    rows = [("N1", "TIDAL", P0, D, "0.5"), ("N2", "TIDAL", P0, D, "0"), ("N3", "PEAT", P0, D, "0"),
            ("N1", "TIDAL", P0, D2, "0.75"), ("N2", "TIDAL", P1, D, "2.125")]
    df = rows_of(spark, rows)
    by_fuel, system = availability(df, [C.group]), availability(df)
    for frame, measure, keys in ((by_fuel, "available_mw", (2, 3, 1)), (system, "total_available_mw", (2, 3))):
        cells = {}
        for row in rows:
            cells.setdefault(tuple(row[k] for k in keys), []).append((row[0], Decimal(row[4])))
        found = frame.collect()
        assert len(found) == len(cells)
        totals = sorted((r[measure], r["bm_units"], r["zero_availability_units"]) for r in found)
        assert totals == sorted(
            (sum(mw for _, mw in c), len({u for u, _ in c}), sum(mw == 0 for _, mw in c))
            for c in cells.values()
        )
    assert reconcile_availability(by_fuel, system).isEmpty()


def test_availability_of_unknown_measures_is_zero(spark):
    df = rows_of(spark, [("U", "X", P0, D, None), ("V", None, P0, D, 5)])
    rows = availability(df, [C.group]).collect()
    assert [(r["fuelType"], r["available_mw"]) for r in rows] == [("X", 0)]


def test_newest_revised_pair_passes_over_a_publication_without_overlap(spark):
    times = [utc("2033-11-02", hour) for hour in (4, 9, 21)]
    rows = [
        ("V1", "PEAT", times[0], "2033-11-05", 30), ("V1", "PEAT", times[1], "2033-11-05", 44),
        ("V2", "TIDE", times[0], "2033-11-06", 12), ("V2", "TIDE", times[1], "2033-11-06", 12),
        ("V1", "PEAT", times[2], "2033-12-24", 90),
    ]
    history = rows_of(spark, rows)
    found = pairs.newest_revised_pair(pairs.all_pair_revisions(history)).collect()
    assert {(r.nationalGridBmUnit, int(r.revisionMW)) for r in found} == {("V1", 14), ("V2", 0)}
    alone = history.filter(F.col("forecastDate") == "2033-12-24")
    assert pairs.newest_revised_pair(pairs.all_pair_revisions(alone)).isEmpty()


def test_newest_pair_is_matched_alone(spark, canon, monkeypatch):
    """The same rows as from all pairs, with only two publications' rows matched at a time."""
    from vintager.workload import with_disjoint_end

    matched = []
    real = pairs.match_publications

    def counted(previous, latest, c=C):
        matched.append((previous.count(), latest.count()))
        return real(previous, latest, c)

    history = with_disjoint_end(canon)
    wanted = pairs.newest_revised_pair(pairs.all_pair_revisions(history))
    monkeypatch.setattr(pairs, "match_publications", counted)
    assert same_rows(pairs.newest_pair_revisions(history), wanted)
    sizes = {r["publishTime"]: r["count"] for r in history.groupBy("publishTime").count().collect()}
    last = sorted(sizes)[-3:]
    assert matched == [(sizes[last[1]], sizes[last[2]]), (sizes[last[0]], sizes[last[1]])]


@pytest.mark.parametrize("hours", [[], [4], [4, 9], [4, 9, 21]])
def test_newest_pair_of_short_histories(spark, hours):
    rows = [("V1", "PEAT", utc("2033-11-02", h), f"2033-11-{h:02d}", h) for h in hours]
    history = rows_of(spark, rows)
    assert pairs.newest_pair_revisions(history).isEmpty()
    undated = [("V1", "PEAT", None, "2033-11-04", 3), ("V2", "TIDE", None, "2033-11-04", 4)]
    assert pairs.newest_pair_revisions(rows_of(spark, rows + undated)).isEmpty()
