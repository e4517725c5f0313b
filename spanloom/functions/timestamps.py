"""Nanosecond instants as BIGINT, with day, minute and TIMESTAMP derived.

Everything is computed from the integer, so that no result depends on the
session time zone and no nanosecond is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_US = 1_000
NS_PER_SECOND = 1_000_000_000
NS_PER_MINUTE = 60 * NS_PER_SECOND
NS_PER_DAY = 86_400 * NS_PER_SECOND


def floor_div(ns: Column, unit: int) -> Column:
    """Whole units since the epoch, rounding down before 1970 too."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(unit)), F.lit(unit).cast("bigint"))


def to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, NS_PER_US))


def to_date(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, NS_PER_DAY).cast("int"))


def to_minute(ns: Column) -> Column:
    return floor_div(ns, NS_PER_MINUTE)


def whole_second(ns: Column) -> Column:
    """The instant with the part below a second cut off, still in ns."""
    return ns - F.pmod(ns, F.lit(NS_PER_SECOND))


def from_timestamp(ts: Column) -> Column:
    return F.unix_micros(ts) * NS_PER_US
