"""Analytics over data that is re-published over time, as Spark DataFrame operators."""

from vintager.columns import Columns

__all__ = ["Columns"]
