"""Conversation-level reads over turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import timestamps
from spanloom.operators import latest

CONVERSATION = ["service_name", "conversation_id"]


def number_turns(turns: DataFrame, slice_seconds: int = 60) -> DataFrame:
    """Add ``turn``: 1, 2, ... within a conversation by start, then trace id.

    One window per conversation would bring a very long conversation into one
    task. Instead turns are ranked inside short time slices, and each slice is
    shifted by the number of turns before it; the running totals see one small
    row per slice. The numbers are the same.
    """
    slice_ns = slice_seconds * timestamps.NS_PER_SECOND
    sliced = turns.withColumn("_slice", timestamps.floor_div(F.col("turn_ns"), slice_ns))
    return _numbered(sliced.repartition(*CONVERSATION, "_slice")).select(*turns.columns, "turn")


def number_deliveries(turns: DataFrame) -> DataFrame:
    """:func:`number_turns` of the turns without repeated deliveries.

    A turn's repeats share its minute, so one distribution by conversation and
    minute serves removing them, ranking, and counting; the turns move once.
    """
    sliced = turns.withColumn("_slice", timestamps.to_minute(F.col("turn_ns")))
    kept = latest.dedup_turns(sliced.repartition(*CONVERSATION, "_slice"), "_slice")
    return _numbered(kept).select(*turns.columns, "turn")


def _numbered(sliced: DataFrame) -> DataFrame:
    """Turns that carry ``_slice`` and are distributed by conversation and slice."""
    inside = Window.partitionBy(*CONVERSATION, "_slice").orderBy("turn_ns", "trace_id")
    earlier = (
        Window.partitionBy(*CONVERSATION)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        sliced.groupBy(*CONVERSATION, "_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            *CONVERSATION, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
        )
    )
    return (
        sliced.withColumn("_rank", F.row_number().over(inside))
        .join(before, [*CONVERSATION, "_slice"])
        .withColumn("turn", (F.col("_rank") + F.col("_before")).cast("bigint"))
    )


def conversation_rollup(turns: DataFrame) -> DataFrame:
    """One row per conversation. It failed if any of its turns did."""
    failed = F.coalesce(F.bool_or(F.col("status_code") == 2), F.lit(False))
    return turns.groupBy(*CONVERSATION).agg(
        F.count(F.lit(1)).alias("turns"),
        F.min("turn_ns").alias("first_turn_ns"),
        F.max("turn_ns").alias("last_turn_ns"),
        F.when(failed, "ERROR").otherwise("OK").alias("status"),
        F.max("workflow").alias("workflow"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
