"""Column expressions: labels, flags, shares, times. All stay in whole-stage codegen."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Direction labels, bands and watch texts.
UP, DOWN, UNCHANGED = "up", "down", "unchanged"
PAIR_UP, PAIR_DOWN, PAIR_UNCHANGED = "UP", "DOWN", "UNCHANGED"
UNKNOWN_UNIT = "Unknown unit"
UNKNOWN_GROUP = "Unknown"
INTERCONNECTOR_PREFIX = "INT"
MAX_ERROR_LENGTH = 5000
ZONE_PATTERN = r"Z$|[+-]\d{2}:\d{2}$"
STABILITY_BANDS = [
    (95, "Highly stable"),
    (90, "Stable"),
    (80, "Moderately stable"),
]
STABILITY_FLOOR = "High revision activity"
WATCH_TEXTS = {
    "positive": (
        "UPWARD BIAS",
        "Latest 24-hour revision activity is net positive across the represented fuel categories.",
    ),
    "negative": (
        "DOWNWARD WATCH",
        "Latest 24-hour revision activity is net negative across the represented fuel categories.",
    ),
    "neutral": (
        "BALANCED",
        "Latest 24-hour upward and downward revision movements are broadly balanced.",
    ),
}


def sign_label(change: Column, up: str, down: str, same: str) -> Column:
    """Label by sign; a NULL change counts as unchanged."""
    return F.when(change > 0, up).when(change < 0, down).otherwise(same)


def direction(change: Column) -> Column:
    return sign_label(change, UP, DOWN, UNCHANGED)


def pair_direction(change: Column) -> Column:
    return sign_label(change, PAIR_UP, PAIR_DOWN, PAIR_UNCHANGED)


def became_unavailable(before: Column, after: Column) -> Column:
    return F.coalesce((before > 0) & (after == 0), F.lit(False))


def returned_available(before: Column, after: Column) -> Column:
    return F.coalesce((before == 0) & (after > 0), F.lit(False))


def is_changed(change: Column) -> Column:
    """Not zero, where an unknown change counts as changed (pair semantics)."""
    return change.isNull() | (change != 0)


def is_interconnector(group: Column) -> Column:
    return group.startswith(INTERCONNECTOR_PREFIX)


def unit_name(entity: Column, alias: Column) -> Column:
    return F.coalesce(entity, alias, F.lit(UNKNOWN_UNIT))


def _ratio_pct(part: Column, whole: Column, digits: int) -> Column:
    exact = part.cast("decimal(28,3)") / whole.cast("decimal(28,3)")
    return F.round(exact * F.lit(100), digits)


def share_or_null(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage; NULL when the whole is zero."""
    return _ratio_pct(part, F.nullif(whole, F.lit(0).cast("int")), digits)


def share_or_zero(part: Column, whole: Column, digits: int) -> Column:
    """Percentage; 0 when the whole is not positive."""
    return F.when(whole > 0, _ratio_pct(part, whole, digits)).otherwise(
        F.lit(0).cast("decimal(10,2)")
    )


def publication_stamp(published: Column) -> Column:
    return F.date_format(published, "yyyyMMdd'T'HHmmss'Z'")


def iso_timestamp(value: Column) -> Column:
    """ISO text of an instant, with the UTC suffix."""
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def zoned_text(text: Column) -> Column:
    """ISO text with a UTC suffix added where it names no zone."""
    return F.when(text.rlike(ZONE_PATTERN), text).otherwise(F.concat(text, F.lit("Z")))


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def stability_band(score: Column) -> Column:
    (first, name), *rest = STABILITY_BANDS
    chain = F.when(score >= first, name)
    for floor, label in rest:
        chain = chain.when(score >= floor, label)
    return chain.otherwise(STABILITY_FLOOR)


def watch_tone(net: Column) -> Column:
    return sign_label(net, "positive", "negative", "neutral")


def watch_text(net: Column, part: int) -> Column:
    """Part 0 is the status, part 1 the sentence."""
    return sign_label(
        net,
        WATCH_TEXTS["positive"][part],
        WATCH_TEXTS["negative"][part],
        WATCH_TEXTS["neutral"][part],
    )


def lenient_timestamp(text: Column) -> Column:
    """Parse; zone offsets are honoured, text without one is UTC, junk is NULL."""
    return F.try_to_timestamp(text)


def lenient_date(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("date")


def lenient_decimal(text: Column, kind: str = "decimal(12,3)") -> Column:
    return text.try_cast(kind)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def utc_instant(value: datetime | str) -> datetime:
    """A bound given with a zone is converted to UTC, one without is taken as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def clipped_error(message: Column) -> Column:
    return F.substring(message, 1, MAX_ERROR_LENGTH)
