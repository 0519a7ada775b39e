"""Scalar functions, labels and display orders."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows_of, utc
from pyspark.sql import functions as F

from vintager.columns import DEFAULT as C
from vintager.functions import labels, scalars
from vintager.operators import pairs, revisions
from vintager.operators.availability import availability
from vintager.plans import presentation, serving
from vintager.plans.relational import to_relational


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "part, whole, pct", [(1, 8, 12.5), (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (5, 0, None)]
)
def test_share_rounds_half_up(spark, part, whole, pct):
    value = one(spark, scalars.share_or_null(F.lit(part), F.lit(whole)))
    assert (None if value is None else float(value)) == pct
    assert float(one(spark, scalars.share_or_zero(F.lit(part), F.lit(whole), 2))) == (pct or 0.0)


@pytest.mark.parametrize(
    "score, band",
    [
        (95, "Highly stable"),
        (94.99, "Stable"),
        (90, "Stable"),
        (80, "Moderately stable"),
        (79.99, "High revision activity"),
    ],
)
def test_stability_bands(spark, score, band):
    assert one(spark, scalars.stability_band(F.lit(score))) == band


@pytest.mark.parametrize("net, tone", [(0.1, "positive"), (-5, "negative"), (0, "neutral")])
def test_watch(spark, net, tone):
    assert one(spark, scalars.watch_tone(F.lit(net))) == tone
    assert one(spark, scalars.watch_text(F.lit(net), 0)) == scalars.WATCH_TEXTS[tone][0]


def test_bounds_are_normalised_to_utc():
    assert scalars.utc_instant("2026-08-12T01:00:00+01:00") == utc("2026-08-12")
    assert scalars.utc_instant(datetime(2026, 8, 12)) == utc("2026-08-12")
    offset = timezone(timedelta(hours=-2))
    assert scalars.utc_instant(datetime(2026, 8, 11, 22, tzinfo=offset)) == utc("2026-08-12")


def test_lenient_parsing(spark):
    assert one(spark, scalars.lenient_decimal(F.lit("bad"))) is None
    assert float(one(spark, scalars.lenient_decimal(F.lit("1.5")))) == 1.5
    assert one(spark, scalars.lenient_date(F.lit("n/a"))) is None
    seconds = F.unix_timestamp(scalars.lenient_timestamp(F.lit("2026-08-12T01:00:00+01:00")))
    assert one(spark, seconds) == int(utc("2026-08-12").timestamp())


def test_stamps_and_zones(spark):
    at = F.lit(utc("2026-08-12", 1, 5))
    assert one(spark, scalars.publication_stamp(at)) == "20260812T010500Z"
    assert one(spark, scalars.iso_timestamp(at)) == "2026-08-12T01:05:00Z"
    for text, zoned in (("2026-08-12T01:00:00", "2026-08-12T01:00:00Z"), ("2026-08-12T01:00:00Z",) * 2, ("2026-08-12T01:00:00+01:00",) * 2):
        assert one(spark, scalars.zoned_text(F.lit(text))) == zoned


def test_unit_name_falls_back(spark):
    null = F.lit(None).cast("string")
    assert one(spark, scalars.unit_name(null, F.lit("T_1"))) == "T_1"
    assert one(spark, scalars.unit_name(null, null)) == "Unknown unit"


def test_nan_becomes_null(spark):
    df = spark.sql("SELECT CAST('NaN' AS DOUBLE) AS a, 1.5D AS b")
    row = to_relational(df, [("a", "x", "decimal(12,3)"), ("b", "y", "decimal(12,3)")]).first()
    assert row["x"] is None and float(row["y"]) == 1.5


def test_labels(spark):
    assert labels.fuel_dimension(spark).count() == 20
    df = spark.createDataFrame([("CCGT",), ("NEW",), ("COAL",)], "fuelType string")
    rows = {r["fuelType"]: r for r in labels.with_labels(df, "fuelType", coded=True).collect()}
    assert rows["CCGT"]["fuel_label"] == "Combined Cycle Gas Turbine (CCGT)"
    assert rows["NEW"]["fuel_label"] == "NEW (NEW)"
    assert (rows["COAL"]["short_label"], rows["NEW"]["short_label"]) == ("COAL", "NEW")
    plan = labels.with_labels(df, "fuelType")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_display_orders(spark):
    p0, p1, d = utc("2026-08-12"), utc("2026-08-12", 1), "2026-08-14"
    df = rows_of(
        spark,
        [
            ("A", "CCGT", p0, d, 1), ("B", "WIND", p0, d, 9), ("C", "OIL", p0, d, 5),
            ("A", "CCGT", p1, d, 1), ("B", "WIND", p1, d, 2), ("C", "OIL", p1, d, 8),
        ],
    )
    fuels = presentation.order_availability(availability(df, [C.group])).collect()
    assert [r["fuelType"] for r in fuels] == ["WIND", "OIL", "CCGT", "OIL", "WIND", "CCGT"]
    assert presentation.order_availability(availability(df)).count() == 2
    unit = pairs.all_pair_revisions(df)
    assert [r["nationalGridBmUnit"] for r in presentation.order_pair_revisions(unit).collect()] == ["B", "C", "A"]
    fuel = presentation.order_pair_revisions(pairs.rollup_pair(unit, [C.group])).collect()
    assert [r["fuelType"] for r in fuel] == ["WIND", "CCGT", "OIL"]
    assert presentation.order_pair_revisions(pairs.rollup_pair(unit)).count() == 1
    counts = presentation.order_directions(serving.direction_counts(revisions.entity_revisions(df)))
    assert [r["direction"] for r in counts.collect()] == ["up", "down", "unchanged"]
    moves = presentation.order_movements(unit, "revisionMW", "nationalGridBmUnit").collect()
    assert [r["nationalGridBmUnit"] for r in moves] == ["B", "C", "A"]
    assert presentation.order_by_pair(pairs.changed_rows_by_adjacent_pair(unit)).count() == 1
