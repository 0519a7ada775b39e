"""Size checks that must hold before a side is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows, not bytes: the callers broadcast narrow rows (a few timestamps each), so
# this stays near 100 MB on an executor.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if a count proves it small; otherwise leave the join to AQE.

    The count is one distributed job. Beyond the limit the join becomes a
    sort-merge join whose hot keys adaptive execution splits.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
