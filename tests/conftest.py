from __future__ import annotations

import os
import sys
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vintager.session import session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    spark = session(
        "vintager-tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def canon(spark):
    """The canonical history of the smallest test data."""
    from vintager.workload import canonical

    return canonical(spark, SMALL)


def utc(day: str, hour: int = 0, minute: int = 0) -> datetime:
    y, m, d = (int(part) for part in day.split("-"))
    return datetime(y, m, d, hour, minute, tzinfo=timezone.utc)


def rows_of(spark, rows):
    """Canonical rows from (unit, fuel, publish time, forecast date, MW[, bmUnit])."""
    from vintager.schema import CANONICAL

    full = []
    for unit, fuel, published, target, mw, *alias in rows:
        full.append(
            (
                "TEST",
                fuel,
                unit,
                alias[0] if alias else None,
                published,
                date.fromisoformat(target) if target else None,
                None if mw is None else Decimal(mw),
                utc("2026-08-12", 2),
            )
        )
    return spark.createDataFrame(full, CANONICAL)


def same_rows(left, right) -> bool:
    """Bag equality of two DataFrames."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    left, right = left.select(*columns), right.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
