from __future__ import annotations

import pytest
from conftest import rows_of, utc
from pyspark.sql import functions as F

from vintager.operators import quality
from vintager.operators.quality import QualityError

P0, P1 = utc("2031-03-05", 6), utc("2031-03-05", 7)
D = "2031-03-09"


@pytest.fixture
def good(spark):
    return rows_of(
        spark, [("A", "X", P0, D, 1), ("B", "X", P0, D, 2), ("A", "X", P1, D, -3)]
    )


def test_verdict_of_a_good_history(good):
    assert quality.assert_quality(good) == {
        "rows": 3,
        "publications": 2,
        "duplicate_source_keys": 0,
        "null_national_grid_bm_units": 0,
        "null_publish_times": 0,
        "null_forecast_dates": 0,
        "null_output_usable": 0,
    }


def test_empty_history_passes_the_history_verdict_only(good):
    assert quality.assert_quality(good.limit(0))["rows"] == 0
    with pytest.raises(QualityError, match="no rows"):
        quality.assert_ingest(good.limit(0))


def test_missing_columns(good):
    with pytest.raises(QualityError, match="bmUnit, collectedAt"):
        quality.assert_quality(good.drop("collectedAt", "bmUnit"))
    with pytest.raises(QualityError, match="outputUsable"):
        quality.assert_ingest(good.drop("outputUsable"))


def test_duplicates_count_keys_in_history_and_rows_at_ingest(good):
    doubled = good.unionByName(good.filter("nationalGridBmUnit = 'B'"))
    with pytest.raises(QualityError, match="'duplicate_source_keys': 1"):
        quality.assert_quality(doubled)
    with pytest.raises(QualityError, match="2 rows"):
        quality.assert_ingest(doubled)


def test_nulls_are_fatal_in_history_and_reported_at_ingest(spark):
    df = rows_of(spark, [("A", "X", P0, D, None), (None, None, P0, D, 1), ("C", "X", None, None, 2)])
    with pytest.raises(QualityError) as error:
        quality.assert_quality(df)
    for name in ("null_national_grid_bm_units", "null_publish_times", "null_forecast_dates", "null_output_usable"):
        assert f"'{name}': 1" in str(error.value)
    report = quality.assert_ingest(df)
    assert report["row_count"] == 3 and report["duplicate_key_rows"] == 0
    assert (report["null_bmUnit"], report["null_fuelType"], report["null_outputUsable"]) == (3, 1, 1)
    assert (report["null_publishTime"], report["null_forecastDate"]) == (1, 1)


def test_negative_measures_are_reported(good):
    assert quality.assert_ingest(good)["negative_output_usable_rows"] == 1
    text = good.withColumn("outputUsable", good["outputUsable"].cast("string"))
    assert quality.negative_rows(text).first()[0] == 1


def test_single_publication_time(good):
    assert quality.single_publication_time(good.filter("outputUsable < 0")) == P1
    with pytest.raises(QualityError, match="found 2"):
        quality.single_publication_time(good)


def test_quality_report_is_one_scan_and_two_shuffles(good):
    plan = quality.quality_report(good)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(nationalGridBmUnit") == 1


def test_equal_bags_have_equal_digests(spark, canon):
    """Order and partitions don't matter; copies, NULLs and single values do."""
    assert quality.differing_publications(canon, canon.orderBy(F.rand(3)).repartition(5)).isEmpty()
    at = utc("2034-02-01", 4)
    rows = [("H4", "TIDE", at, "2034-02-07", 2), ("H5", "TIDE", at, "2034-02-07", 3)]
    base = rows_of(spark, rows).drop("collectedAt").withColumn("collectedAt", F.lit(at))

    def of(*cells):
        return rows_of(spark, list(cells)).drop("collectedAt").withColumn("collectedAt", F.lit(at))

    for other, sizes in (
        (of(*rows, rows[0]), (2, 3)),
        (of(rows[0]), (2, 1)),
        (of(rows[0], (*rows[1], "")), (2, 2)),
        (of(*rows, (None, "TIDE", None, None, 1)), (0, 1)),
    ):
        (found,) = quality.differing_publications(base, other).collect()
        assert (found["left_rows"], found["right_rows"]) == sizes
        assert not quality.differing_rows(base, other).isEmpty()
    # Two copies of a row cancel out in an exclusive or, not in a sum.
    twice = of(*rows, ("H6", "TIDE", at, "2034-02-07", 9), ("H6", "TIDE", at, "2034-02-07", 9))
    swapped = of(*rows, ("H7", "TIDE", at, "2034-02-07", 9), ("H7", "TIDE", at, "2034-02-07", 9))
    assert quality.differing_publications(twice, swapped).count() == 1
    assert quality.differing_rows(twice, swapped).count() == 2
