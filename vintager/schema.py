"""Fixed schemas: canonical rows, landing JSON, and the relational tables."""

from __future__ import annotations

from pyspark.sql import types as T

CANONICAL = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("fuelType", T.StringType()),
        T.StructField("nationalGridBmUnit", T.StringType()),
        T.StructField("bmUnit", T.StringType()),
        T.StructField("publishTime", T.TimestampType()),
        T.StructField("forecastDate", T.DateType()),
        T.StructField("outputUsable", T.DecimalType(12, 3)),
        T.StructField("collectedAt", T.TimestampType()),
    ]
)

# Landing files are read as text and parsed leniently, so that one bad value
# becomes NULL and reaches the quality report instead of failing the scan.
LANDING = T.StructType(
    [
        T.StructField(f.name, T.StringType())
        for f in CANONICAL
        if f.name != "collectedAt"
    ]
)

# Relational layouts as (source column, table column, table type).
RAW_TABLE = [
    ("nationalGridBmUnit", "national_grid_bm_unit", "string"),
    ("bmUnit", "bm_unit", "string"),
    ("fuelType", "fuel_type", "string"),
    ("publishTime", "publish_time", "timestamp"),
    ("forecastDate", "forecast_date", "date"),
    ("outputUsable", "output_usable_mw", "decimal(12,3)"),
    ("collectedAt", "collected_at", "timestamp"),
    ("dataset", "dataset", "string"),
]

GROUP_AVAILABILITY_TABLE = [
    ("publishTime", "publish_time", "timestamp"),
    ("forecastDate", "forecast_date", "date"),
    ("fuelType", "fuel_type", "string"),
    ("available_mw", "available_mw", "decimal(14,3)"),
    ("bm_units", "bm_units", "int"),
    ("zero_availability_units", "zero_availability_units", "int"),
]

SYSTEM_AVAILABILITY_TABLE = [
    ("publishTime", "publish_time", "timestamp"),
    ("forecastDate", "forecast_date", "date"),
    ("total_available_mw", "total_available_mw", "decimal(14,3)"),
    ("bm_units", "bm_units", "int"),
    ("zero_availability_units", "zero_availability_units", "int"),
]

UNIT_REVISION_TABLE = [
    ("previousPublishTime", "previous_publish_time", "timestamp"),
    ("latestPublishTime", "latest_publish_time", "timestamp"),
    ("forecastDate", "forecast_date", "date"),
    ("nationalGridBmUnit", "national_grid_bm_unit", "string"),
    ("fuelType", "fuel_type", "string"),
    ("previousAvailableMW", "previous_available_mw", "decimal(12,3)"),
    ("latestAvailableMW", "latest_available_mw", "decimal(12,3)"),
    ("revisionMW", "revision_mw", "decimal(12,3)"),
    ("absoluteRevisionMW", "absolute_revision_mw", "decimal(12,3)"),
    ("changeDirection", "change_direction", "string"),
    ("becameUnavailable", "became_unavailable", "boolean"),
    ("returnedAvailable", "returned_available", "boolean"),
]

SYSTEM_REVISION_TABLE = [
    ("previousPublishTime", "previous_publish_time", "timestamp"),
    ("latestPublishTime", "latest_publish_time", "timestamp"),
    ("forecastDate", "forecast_date", "date"),
    ("previousAvailableMW", "previous_available_mw", "decimal(14,3)"),
    ("latestAvailableMW", "latest_available_mw", "decimal(14,3)"),
    ("revisionMW", "revision_mw", "decimal(14,3)"),
    ("changedUnits", "changed_units", "int"),
    ("becameUnavailableUnits", "became_unavailable_units", "int"),
    ("returnedAvailableUnits", "returned_available_units", "int"),
]

GROUP_REVISION_TABLE = (
    SYSTEM_REVISION_TABLE[:3]
    + [("fuelType", "fuel_type", "string")]
    + SYSTEM_REVISION_TABLE[3:]
)

# Keys of the relational tables. Every key holds the publication time the table
# is partitioned by, so an upsert only ever touches the partitions it writes.
RAW_KEY = ["national_grid_bm_unit", "publish_time", "forecast_date"]
GROUP_AVAILABILITY_KEY = ["publish_time", "forecast_date", "fuel_type"]
SYSTEM_AVAILABILITY_KEY = ["publish_time", "forecast_date"]
SYSTEM_REVISION_KEY = ["previous_publish_time", "latest_publish_time", "forecast_date"]
UNIT_REVISION_KEY = SYSTEM_REVISION_KEY + ["national_grid_bm_unit"]
GROUP_REVISION_KEY = SYSTEM_REVISION_KEY + ["fuel_type"]
