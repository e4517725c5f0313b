"""First row per group after a sort, and the reads built on it.

``row_number() <= n`` makes Spark put a group limit in front of the shuffle as
well: each task sends on at most ``n`` rows per key, so a key that holds a
large share of the table costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import timestamps
from spanloom.sources.days import HASH, PART


def limit_by(
    df: DataFrame, n: int, keys: Sequence[str | Column], order: Sequence[Column]
) -> DataFrame:
    """The first ``n`` rows per key. The order is mandatory: without it the
    rows kept would be arbitrary."""
    if not order:
        raise ValueError("limit_by needs an order")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def latest_eval_scores(scores: DataFrame) -> DataFrame:
    return limit_by(
        scores,
        1,
        ["service_name", "monitor_uuid", "conversation_id", "eval_type"],
        [F.desc("scored_at"), F.desc("batch_id"), F.desc("score")],
    )


def latest_cluster_assignments(assignments: DataFrame) -> DataFrame:
    return limit_by(
        assignments,
        1,
        ["service_name", "conversation_id", "space_uuid"],
        [F.desc("classified_at"), F.desc("taxonomy_version"), F.desc("batch_id"),
         F.desc("cluster_key")],
    )


def latest_batches(batches: DataFrame) -> DataFrame:
    """Current status per batch; ``complete`` wins within the same second."""
    return limit_by(
        batches,
        1,
        ["batch_id"],
        [F.desc("created_at"), F.desc(F.col("status") == "complete"),
         F.desc("completed_rows"), F.desc("failed_rows"), F.desc("total_rows")],
    )


def _laid(rows: DataFrame) -> list[str]:
    """The trace's hash, where there is one: it follows from the key, so that filters on it reach the scan."""
    return [HASH] if HASH in rows.columns else []


def _dealt(rows: DataFrame) -> list[str]:
    """The part that compaction gave the row; it follows from the key, and rows dealt out by it are not shuffled again."""
    return [PART] if PART in rows.columns else []


def dedup_spans(spans: DataFrame) -> DataFrame:
    """One row per span; the last delivery wins.

    ``date`` and ``service_name`` are part of the key, so a filter on them
    still reaches the scan underneath. Key and order are narrow columns: a read
    that needs no message texts does not move any.
    """
    return limit_by(
        spans,
        1,
        ["date", *_laid(spans), "service_name", timestamps.to_minute(F.col("start_ns")), "trace_id", "span_id", *_dealt(spans)],
        [F.desc("_ingest_id"), F.desc("end_ns"), F.desc("start_ns")],
    )


def dedup_turns(turns: DataFrame, minute: str | None = None) -> DataFrame:
    """One row per turn; the last delivery wins. ``minute`` names a column that
    holds the minute already."""
    at = timestamps.to_minute(F.col("turn_ns")) if minute is None else F.col(minute)
    return limit_by(
        turns,
        1,
        ["date", *_laid(turns), "service_name", at, "conversation_id", "trace_id", *_dealt(turns)],
        [F.desc("_ingest_id"), F.desc("turn_ns")],
    )
