"""Time rules. ``now`` is always an argument, in epoch seconds, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400
SECONDS_PER_MONTH = 30.44 * 24 * 3600
# Fixed value: epoch seconds past which a time does not fit into 64-bit nanoseconds.
LATEST_EPOCH = 9_223_372_036


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds to a timestamp; null, 0 and numbers out of range give null."""
    usable = (seconds != 0) & (F.abs(seconds) <= LATEST_EPOCH)
    return F.when(usable, F.timestamp_seconds(seconds.cast("bigint")))


def from_iso(text: Column) -> Column:
    """ISO text to a timestamp; text that cannot be read gives null."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def from_variant(value: Column) -> Column:
    """Number as epoch seconds, text as ISO time, anything else null."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind == "STRING", from_iso(F.try_variant_get(value, "$", "string"))).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), from_epoch(number)
    )


def days_since(moment: Column, now: float) -> Column:
    """Whole days between ``moment`` and ``now``, rounded down."""
    elapsed = F.lit(int(now * 1_000_000)) - F.unix_micros(moment)
    return F.floor(elapsed / F.lit(SECONDS_PER_DAY * 1_000_000.0)).cast("int")


def months_since(epoch_seconds: Column, now: float) -> Column:
    """Months of 30.44 days between ``epoch_seconds`` and ``now``, cut toward zero."""
    return ((F.lit(float(now)) - epoch_seconds) / F.lit(SECONDS_PER_MONTH)).cast("int")
