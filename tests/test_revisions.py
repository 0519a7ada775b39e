"""Revisions against the last appearance of a series."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import rows_of, same_rows, utc
from pyspark.sql import functions as F

from vintager import workload
from vintager.columns import DEFAULT as C
from vintager.operators import neighbours, publications, revisions
from vintager.operators.availability import group_history, system_history

P0, P1, P2 = (utc("2031-03-05", hour) for hour in (6, 7, 9))
D = "2031-03-09"
# Three publications: Q skips the second, W changes fuel in the third, E returns to where it was.
TABLE = [
    ("Q", "PEAT", P0, "10.5"), ("W", "PEAT", P0, "4"), ("E", "TIDAL", P0, "6.125"),
    ("W", "PEAT", P1, "4.375"), ("E", "TIDAL", P1, "5"),
    ("Q", "PEAT", P2, "8"), ("W", "COAL", P2, "3"), ("E", "TIDAL", P2, "6.125"),
]


@pytest.fixture
def small(spark):
    return rows_of(spark, [(unit, fuel, time, D, mw) for unit, fuel, time, mw in TABLE])


def test_group_and_system_history(small):
    groups, systems = {}, {}
    for _, fuel, time, mw in TABLE:
        groups[fuel, time] = groups.get((fuel, time), 0) + Decimal(mw)
        systems[time] = systems.get(time, 0) + Decimal(mw)
    by_group = group_history(small)
    assert sorted(r["availableMW"] for r in by_group.collect()) == sorted(groups.values())
    found = [r["availableMW"] for r in system_history(by_group).orderBy("publishTime").collect()]
    assert found == [systems[time] for time in (P0, P1, P2)]


def test_each_appearance_is_compared_with_the_one_before(small):
    expected, last = [], {}
    for unit, fuel, time, mw in TABLE:
        if unit in last:
            change = Decimal(mw) - last[unit][1]
            direction = "up" if change > 0 else "down" if change else "unchanged"
            expected.append((unit, change, direction, last[unit][0], fuel != last[unit][0]))
        last[unit] = fuel, Decimal(mw)
    rows = revisions.entity_revisions(small).select(
        "nationalGridBmUnit", "revisionMW", "revisionDirection", "previousFuelType", "fuelTypeChanged"
    )
    assert sorted(map(tuple, rows.collect())) == sorted(expected)


def test_system_revisions_sum_to_the_whole_change(small):
    system = system_history(group_history(small))
    rows = revisions.series_revisions(system, C.total_series).orderBy("latestPublishTime").collect()
    assert [r["revisionMW"] for r in rows] == [Decimal("-11.25"), Decimal("7.75")]
    assert [r["revisionDirection"] for r in rows] == ["down", "up"]


def test_unknown_measure_is_unchanged_and_gap_is_bridged(spark):
    p2 = utc("2031-03-05", 8)
    df = rows_of(
        spark,
        [
            ("U", "X", P0, D, 10),
            ("V", "X", P0, D, 5),
            ("V", "X", P1, D, None),
            ("U", "X", p2, D, 30),
        ],
    )
    rows = {r["nationalGridBmUnit"]: r for r in revisions.entity_revisions(df).collect()}
    assert rows["U"]["revisionMW"] == 20 and rows["U"]["previousPublishTime"] is not None
    assert rows["V"]["revisionMW"] is None and rows["V"]["revisionDirection"] == "unchanged"


@pytest.mark.parametrize("chunk", ["YEAR", "MONTH", "DAY", "HOUR"])
def test_chunks_do_not_change_the_result(canon, chunk):
    assert same_rows(
        revisions.entity_revisions(canon, chunk=None), revisions.entity_revisions(canon, chunk=chunk)
    )


def test_chunked_plan_bounds_every_window_and_reuses_the_shuffle(canon):
    df = revisions.entity_revisions(canon, chunk="DAY")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_chunk_unit_follows_the_number_of_publications(canon):
    assert neighbours.chunk_unit(canon, "publishTime") is None
    # 60 publications in one January, two a day.
    assert neighbours.chunk_unit(canon, "publishTime", max_rows=59) == "DAY"
    assert neighbours.chunk_unit(canon, "publishTime", max_rows=1) == "HOUR"


def test_one_hot_series(spark):
    """One series holds almost all rows; every revision is still there, chunked or not."""
    hot = spark.range(5000).select(
        F.lit("TEST").alias("dataset"),
        F.lit("X").alias("fuelType"),
        F.lit("HOT").alias("nationalGridBmUnit"),
        F.lit(None).cast("string").alias("bmUnit"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 900).alias("publishTime"),
        F.lit("2030-01-01").cast("date").alias("forecastDate"),
        (F.col("id") * F.col("id") % 97).alias("outputUsable"),
        F.current_timestamp().alias("collectedAt"),
    )
    chunked = revisions.entity_revisions(hot, chunk="DAY").drop("collectedAt")
    assert chunked.count() == 4999
    assert same_rows(chunked, revisions.entity_revisions(hot, chunk=None).drop("collectedAt"))


def test_rows_without_a_unit_are_one_hot_series(spark, monkeypatch):
    """Few publications don't bound it; its rows do, and its windows stay within the bound."""
    times = [utc("2033-07-04", hour) for hour in (2, 7, 13, 22)]
    hot = [(None, "PEAT", t, "2033-07-09", 10 * i * i) for i, t in enumerate(times) for _ in range(60)]
    cold = [(f"W{n}", "TIDE", t, "2033-07-09", n * i) for i, t in enumerate(times) for n in range(20)]
    df = rows_of(spark, hot + cold).drop("collectedAt").withColumn("collectedAt", F.lit(times[0]))
    whole = revisions.entity_revisions(df, chunk=None)
    monkeypatch.setattr(neighbours, "SERIES_ROWS", 100)
    assert neighbours.chunk_unit(df, "publishTime") is None
    unit = neighbours.chunk_unit(df, "publishTime", series=C.entity_series)
    assert unit == "HOUR"
    per_window = df.groupBy(*C.entity_series, F.date_trunc(unit, "publishTime")).count()
    assert per_window.agg(F.max("count")).first()[0] <= 100
    found = revisions.entity_revisions(df)
    assert "date_trunc(HOUR" in found._jdf.queryExecution().optimizedPlan().toString()
    assert same_rows(found, whole) and found.count() == 60 * 4 - 1 + 60
    monkeypatch.setattr(neighbours, "SERIES_ROWS", 240)
    assert neighbours.chunk_unit(df, "publishTime", series=C.entity_series) is None


def test_revisions_of_a_series_sum_to_last_minus_first(canon):
    change = revisions.entity_revisions(canon).groupBy(*C.entity_series).agg(
        F.sum("revisionMW").alias("total")
    )
    ends = canon.groupBy(*C.entity_series).agg(
        (F.max_by("outputUsable", "publishTime") - F.min_by("outputUsable", "publishTime")).alias(
            "span"
        )
    )
    assert change.join(ends, C.entity_series).filter("total <> span").isEmpty()


@pytest.mark.parametrize("hours", [12, 24, 36, 240])
def test_recent_equals_filtered_history(canon, hours):
    full = publications.trailing(revisions.entity_revisions(canon), hours)
    assert same_rows(revisions.recent_entity_revisions(canon, hours), full)
    by_group = group_history(canon)
    fuel = revisions.series_revisions(by_group, C.group_series)
    assert same_rows(
        revisions.recent_series_revisions(by_group, C.group_series, hours),
        publications.trailing(fuel, hours),
    )


def test_window_ends_at_the_newest_revision_not_the_newest_publication(spark):
    p2 = utc("2031-03-06", 18)
    df = rows_of(
        spark,
        [
            ("U", "X", P0, D, 10),
            ("U", "X", P1, D, 20),
            ("NEW", "X", p2, "2031-03-20", 5),
        ],
    )
    assert [r["nationalGridBmUnit"] for r in revisions.recent_entity_revisions(df).collect()] == ["U"]


def test_trailing_window_is_half_open(spark):
    times = [utc("2026-08-11", 0), utc("2026-08-12", 0), utc("2026-08-12", 12), utc("2026-08-13", 0)]
    df = rows_of(spark, [("U", "X", t, D, i) for i, t in enumerate(times)])
    kept = publications.trailing(revisions.entity_revisions(df), 24)
    assert sorted(r["revisionMW"] for r in kept.collect()) == [1, 1]
    assert kept.agg(F.min("previousPublishTime")).first()[0] is not None
    assert kept.count() == 2


def test_changed_rows_by_pair(small):
    rows = revisions.changed_rows_by_pair(revisions.entity_revisions(small)).collect()
    assert sum(r["changedRows"] for r in rows) == 5


def test_expected_counts_of_the_workload(canon):
    counts = dict(
        revisions.entity_revisions(canon).groupBy("revisionDirection").count().collect()
    )
    assert counts == {"up": 269, "down": 278, "unchanged": 130}
    assert canon.count() == 782
    assert workload.stored(canon).count() < 782


def test_total_rank_equals_row_number(spark, canon):
    from pyspark.sql import Window

    ranked = neighbours.with_total_rank(
        canon, ["forecastDate"], [F.col("outputUsable").desc(), F.col("nationalGridBmUnit").asc(), F.col("publishTime").asc()], "r"
    )
    window = Window.partitionBy("forecastDate").orderBy(
        F.col("outputUsable").desc(), "nationalGridBmUnit", "publishTime"
    )
    expected = canon.withColumn("r", F.row_number().over(window).cast("bigint"))
    assert same_rows(ranked, expected)


def test_calendar(spark):
    times = [utc("2026-08-12", 23), utc("2026-08-13", 1), utc("2026-08-13", 5), utc("2026-08-20")]
    df = rows_of(spark, [("U", "X", t, D, 1) for t in reversed(times)])
    rows = publications.publication_calendar(df).orderBy("publicationNumber").select(
        *[F.unix_timestamp(c).alias(c) for c in ("publishTime", "previousPublishTime", "nextPublishTime")],
        "publicationNumber",
    ).collect()
    seconds = [int(t.timestamp()) for t in times]
    assert [r["publishTime"] for r in rows] == seconds
    assert [r["previousPublishTime"] for r in rows] == [None, *seconds[:-1]]
    assert [r["nextPublishTime"] for r in rows] == [*seconds[1:], None]
    assert [r["publicationNumber"] for r in rows] == [1, 2, 3, 4]


def test_latest_publications_need_n(spark):
    one = rows_of(spark, [("U", "X", P0, D, 1)])
    assert publications.latest_publications(one, 2).isEmpty()
    assert publications.latest_publication(one).count() == 1
    with pytest.raises(publications.NoPublications):
        publications.require_publications(one.limit(0))


def test_nearest_forecast_is_not_before_the_publication(spark):
    df = rows_of(
        spark,
        [
            ("U", "X", P1, "2031-03-05", 1),
            ("U", "X", P1, "2031-03-06", 2),
            ("U", "X", P1, "2031-03-07", 3),
        ],
    )
    assert [r["outputUsable"] for r in publications.nearest_forecast(df).collect()] == [2]


def test_total_rank_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 9)], "g string, x int")
    ranked = neighbours.with_total_rank(rows, ["g"], [F.col("x").desc()], "rank")
    assert sorted(map(tuple, ranked.collect()), key=str) == sorted(
        [(None, 3, 1), (None, 1, 2), ("a", 9, 1), ("a", 2, 2)], key=str
    )
