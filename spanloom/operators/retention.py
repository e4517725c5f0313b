"""Retention: what is old enough to go, and removing it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import timestamps
from spanloom.operators.filters import _epoch_ns
from spanloom.sources import days as compacted
from spanloom.sources.tables import PARTITION, TABLES, Store, Table

DEFAULT_DAYS = 30
QUEUE_DAYS = 30
"""Fixed for the queue tables, whatever the retention setting says."""


def ttl_days(table: Table, days: int = DEFAULT_DAYS) -> int:
    return days if table.follows_retention_setting else QUEUE_DAYS


def unexpired(df: DataFrame, clock_ns: Column, days: int, as_of: dt.datetime) -> DataFrame:
    """Rows not yet expired at ``as_of``, one by one."""
    return df.where(clock_ns > F.lit(_epoch_ns(as_of) - days * timestamps.NS_PER_DAY))


def first_kept_day(days: int, as_of: dt.datetime, by_day: bool = False) -> dt.date:
    """Oldest day still stored at ``as_of``.

    Where the age counts from the instant of a row, a day stays as long as any
    of it may be unexpired; where it counts from the day, the whole day expires
    when it begins to be ``days`` old.
    """
    utc = as_of if as_of.tzinfo is None else as_of.astimezone(dt.timezone.utc)
    day = (utc - dt.timedelta(days=days)).date()
    return day + dt.timedelta(days=1) if by_day else day


def in_kept_days(
    df: DataFrame, days: int, as_of: dt.datetime, by_day: bool = False
) -> DataFrame:
    """Rows that are still stored when only whole days are dropped."""
    return df.where(F.col("date") >= F.lit(first_kept_day(days, as_of, by_day)))


def apply_retention(
    store: Store, table: Table, as_of: dt.datetime, days: int = DEFAULT_DAYS
) -> list[str]:
    """Remove what has expired; returns the partitions that were dropped.

    Whole partitions are dropped by name, without reading them. Where rows
    expire one by one, the day the cut-off falls into is rewritten without its
    expired rows. Rows appended to that very day meanwhile would be lost; it is
    ``days`` old, so nothing is, unless late rows carry old clocks.
    """
    kept_from = first_kept_day(ttl_days(table, days), as_of, table.expires_by_day)
    oldest = str(kept_from)
    dropped = [p for p in store.partitions(table) if p < oldest]
    for value in dropped:
        store.drop_partition(table, value)
    dropped = sorted({*dropped, *compacted.drop_days(store, table, oldest)})
    if not table.whole_partitions and oldest in store.partitions(table):
        boundary = store.read(table).where(F.col(PARTITION) == F.lit(kept_from))
        kept = unexpired(boundary, table.clock_ns(), ttl_days(table, days), as_of)
        if kept.isEmpty():
            store.drop_partition(table, oldest)
        else:
            store.replace_partition(kept, table, oldest)
    return dropped


def apply_retention_everywhere(
    store: Store, as_of: dt.datetime, days: int = DEFAULT_DAYS
) -> dict[str, list[str]]:
    return {t.name: apply_retention(store, t, as_of, days) for t in TABLES.values()}
