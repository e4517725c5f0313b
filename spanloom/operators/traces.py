"""Trace bounds, trace fetch and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import timestamps


def trace_bounds(raw: DataFrame) -> DataFrame:
    """First and last span *start* per trace, in whole seconds.

    Run on one block of spans it yields that block's partial rows; see
    :func:`merge_trace_bounds`.
    """
    second = timestamps.whole_second(F.col("timestamp_ns"))
    return (
        raw.where(F.col("trace_id") != "")
        .groupBy("trace_id")
        .agg(F.min(second).alias("first_start_ns"), F.max(second).alias("last_start_ns"))
    )


def merge_trace_bounds(partials: DataFrame) -> DataFrame:
    return partials.groupBy("trace_id").agg(
        F.min("first_start_ns").alias("first_start_ns"),
        F.max("last_start_ns").alias("last_start_ns"),
    )


def fetch_trace(raw: DataFrame, bounds: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace, reading only the days the trace touches.

    The bounds are one aggregated row; as scalar subqueries they are known
    before the scan of the big table starts, which then prunes its partitions.
    """
    own = bounds.where(F.col("trace_id") == trace_id)
    first = own.agg(F.min("first_start_ns")).scalar()
    last = own.agg(F.max("last_start_ns")).scalar()
    ns = F.col("timestamp_ns")
    pruned = raw.where(
        (F.col("trace_id") == trace_id)
        & (ns >= first)
        & (ns < last + timestamps.NS_PER_SECOND)
    )
    if "date" in raw.columns:
        first_day = own.agg(timestamps.to_date(F.min("first_start_ns"))).scalar()
        last_day = own.agg(timestamps.to_date(F.max("last_start_ns"))).scalar()
        pruned = pruned.where(F.col("date").between(first_day, last_day))
    return pruned


FEW_TRACES = 10_000
"""So many trace ids and their bounds, some 100 bytes each, are sent to every task."""


def fetch_traces(raw: DataFrame, bounds: DataFrame, wanted: DataFrame) -> DataFrame:
    """As :func:`fetch_trace` for a set of trace ids (column ``trace_id``).

    ``wanted`` may be large, so it is counted up to ``FEW_TRACES``: so many are
    sent to every task, more are merged with the spans. The optimizer is not left
    to choose: by the bytes of a compressed file the few columns a read asks for
    look small, and it broadcast the spans themselves. On a table with a ``date``
    column partitions no wanted trace touches are not read; where many join, the
    days of each trace join as well.
    """
    wanted = wanted.distinct()
    few = wanted.limit(FEW_TRACES + 1).count() <= FEW_TRACES

    def sized(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows.hint("merge")

    ranges = merge_trace_bounds(bounds.join(sized(wanted), "trace_id", "left_semi"))
    keys = ["trace_id"]
    if "date" in raw.columns:
        first_day = timestamps.to_date(F.col("first_start_ns"))
        last_day = timestamps.to_date(F.col("last_start_ns"))
        days = ranges.select("*", F.explode(F.sequence(first_day, last_day)).alias("date"))
        # A set of days, however many traces there are; known before the scan of
        # the big table starts, which then opens no other partition.
        touched = days.agg(F.collect_set("date")).scalar()
        raw = raw.where(F.array_contains(touched, F.col("date")))
        if not few:
            ranges = days
            keys.append("date")
    ns = F.col("timestamp_ns")
    return (
        raw.join(sized(ranges), keys)
        .where(
            (ns >= F.col("first_start_ns"))
            & (ns < F.col("last_start_ns") + timestamps.NS_PER_SECOND)
        )
        .select(*raw.columns)
    )


def count_rows(df: DataFrame, condition: str | None = None) -> DataFrame:
    kept = df if condition is None else df.where(condition)
    return kept.agg(F.count(F.lit(1)).alias("n"))


SPINE_CHUNK = 100_000
"""Buckets that one row of the spine stands for before it is expanded."""


def trace_time_series(
    spans: DataFrame,
    bucket_seconds: int,
    ns_col: str = "start_ns",
    first_ns: int | None = None,
    last_ns: int | None = None,
) -> DataFrame:
    """Spans per time bucket from the first to the last one, empty ones as 0.

    ``first_ns`` and ``last_ns`` (inclusive) bound the series, and the spans
    counted, where they are given. The spans are read once and counted before
    any shuffle; first and last come from the counts. The spine between them is
    laid out in chunks that are expanded in parallel, however far apart they are.
    """
    width = bucket_seconds * timestamps.NS_PER_SECOND
    if first_ns is not None:
        spans = spans.where(F.col(ns_col) >= first_ns)
    if last_ns is not None:
        spans = spans.where(F.col(ns_col) <= last_ns)
    counts = (
        spans.where(F.col(ns_col).isNotNull())
        .groupBy(timestamps.floor_div(F.col(ns_col), width).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = counts.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    given = {"first": first_ns, "last": last_ns}
    ends = ends.withColumns(
        {name: F.coalesce(F.lit(None if ns is None else ns // width).cast("bigint"), F.col(name)) for name, ns in given.items()}
    ).where("first IS NOT NULL AND first <= last")
    chunks = ends.select(
        "first",
        "last",
        F.explode(F.sequence(timestamps.floor_div(F.col("first"), SPINE_CHUNK), timestamps.floor_div(F.col("last"), SPINE_CHUNK))).alias("chunk"),
    ).repartition("chunk")
    begin = F.greatest("first", F.col("chunk") * SPINE_CHUNK)
    end = F.least("last", F.col("chunk") * SPINE_CHUNK + (SPINE_CHUNK - 1))
    spine = chunks.select(F.explode(F.sequence(begin, end)).alias("bucket"))
    return spine.join(counts, "bucket", "left").select(
        (F.col("bucket") * width).alias("bucket_ns"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )
