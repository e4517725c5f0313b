"""Lookups and filters over spans and turns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import timestamps
from spanloom.sources.days import trace_draw


def in_range(rows: DataFrame, ns_col: str, first_ns: int | None, last_ns: int | None) -> DataFrame:
    """Rows whose instant lies between the two, both included; None leaves that side open.

    The day follows from the instant, but Spark can't know that: where there is
    a ``date`` column it is asked for too, so that other days are not read.
    """
    for bound, at_least in ((first_ns, True), (last_ns, False)):
        if bound is None:
            continue
        day = F.lit(EPOCH_DAY + dt.timedelta(days=bound // timestamps.NS_PER_DAY))
        for column, limit in ((ns_col, F.lit(bound)), *((("date", day),) if "date" in rows.columns else ())):
            rows = rows.where(F.col(column) >= limit if at_least else F.col(column) <= limit)
    return rows


EPOCH_DAY = dt.date(1970, 1, 1)


def has_attribute(keys: Column, key: str) -> Column:
    return F.array_contains(keys, key)


def with_attribute(
    df: DataFrame,
    key: str,
    value: str | None = None,
    keys_col: str = "span_attributes_keys",
    attrs_col: str = "span_attributes",
) -> DataFrame:
    """Rows that carry ``key``, and with ``value`` given only those with that text."""
    found = df.where(has_attribute(F.col(keys_col), key))
    if value is None:
        return found
    return found.where(F.try_variant_get(F.col(attrs_col)[key], "$", "string") == value)


def find_trace(spans: DataFrame, trace_id: str, limit: int | None = None) -> DataFrame:
    found = spans.where(F.col("trace_id") == trace_id)
    return found if limit is None else found.limit(limit)


def find_span(spans: DataFrame, span_id: str) -> DataFrame:
    return spans.where(F.col("span_id") == span_id)


def find_conversation(turns: DataFrame, conversation_id: str) -> DataFrame:
    return turns.where(F.col("conversation_id") == conversation_id)


def duration_between(spans: DataFrame, low_ns: int, high_ns: int) -> DataFrame:
    return spans.where(F.col("duration_ns").between(low_ns, high_ns))


def in_workflow(conversations: DataFrame, workflow: str) -> DataFrame:
    return conversations.where(F.col("workflow") == workflow)


def started_between(
    df: DataFrame, first: dt.datetime, last: dt.datetime, ns_col: str = "start_ns"
) -> DataFrame:
    """Rows with ``first <= start < last`` (UTC).

    The day range is stated too: a filter on the instant alone would not prune
    the ``date`` partitions.
    """
    first_ns, last_ns = _epoch_ns(first), _epoch_ns(last)
    last_day = dt.date(1970, 1, 1) + dt.timedelta(days=(last_ns - 1) // timestamps.NS_PER_DAY)
    first_day = dt.date(1970, 1, 1) + dt.timedelta(days=first_ns // timestamps.NS_PER_DAY)
    return df.where(
        F.col("date").between(F.lit(first_day), F.lit(last_day))
        & (F.col(ns_col) >= first_ns)
        & (F.col(ns_col) < last_ns)
    )


def _epoch_ns(instant: dt.datetime) -> int:
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=dt.timezone.utc)
    since = instant - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return (since.days * 86_400 + since.seconds) * timestamps.NS_PER_SECOND + (
        since.microseconds * timestamps.NS_PER_US
    )


def sample_traces(df: DataFrame, fraction: float) -> DataFrame:
    """A deterministic share of the *traces*; a trace is kept or left whole.

    The sample depends on the trace id alone, so every table and every run
    picks the same traces.
    """
    return df.where(trace_draw() < draw_limit(fraction))


def draw_limit(fraction: float) -> int:
    """Traces whose :func:`~spanloom.sources.days.trace_draw` is less make up ``fraction`` of all."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    return int(fraction * 2**32)
