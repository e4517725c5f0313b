"""Raw span -> normalized span: one flat row whichever dialect emitted it.

Purely row-wise: no shuffle, and the same function serves batch and stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import attribute_keys as K
from spanloom.functions import messages, timestamps
from spanloom.functions.attributes import attr_equals, first_non_empty, first_uint32
from spanloom.functions.reuse import built_once


def status_code(status: Column) -> Column:
    """2, 1 or 0 by the exact status name, NULL for any other text."""
    code = F.lit(None).cast("smallint")
    for name, number in K.STATUS_CODES.items():
        code = F.when(status == name, F.lit(number).cast("smallint")).otherwise(code)
    return code


def is_llm_call(attrs: Column) -> Column:
    return (first_non_empty(attrs, K.MODEL_KEYS) != "") | attr_equals(
        attrs, K.OPERATION_KEY, K.CHAT_OPERATION
    )


def is_tool_call(attrs: Column) -> Column:
    result = F.lit(False)
    for key, value in K.TOOL_MARKERS:
        result = result | attr_equals(attrs, key, value)
    return result


@built_once
def _message_columns() -> list[Column]:
    attrs, events = F.col("span_attributes"), F.col("events")
    return [
        messages.prompts(attrs, events).alias("prompts"),
        messages.completions(attrs, events).alias("completions"),
    ]


@built_once
def _normalized_columns() -> list[Column]:
    attrs, events, start = F.col("span_attributes"), F.col("events"), F.col("timestamp_ns")
    end_ns = start + F.col("duration_ns")
    as_they_are = [
        "resource_attributes", "resource_attributes_keys", "span_attributes",
        "span_attributes_keys", "events", "links", "prompts", "completions",
    ]
    return [
        *map(F.col, ("service_name", "trace_id", "span_id", "parent_span_id", "span_name")),
        start.alias("start_ns"),
        end_ns.alias("end_ns"),
        F.col("duration_ns"),
        timestamps.to_timestamp(start).alias("start_time"),
        timestamps.to_timestamp(end_ns).alias("end_time"),
        status_code(F.col("status_code")).alias("status_code"),
        F.col("status_message"),
        messages.exception_attr(events, K.EXCEPTION_TYPE).alias("exception_type"),
        messages.exception_attr(events, K.EXCEPTION_MESSAGE).alias("exception_message"),
        first_non_empty(attrs, K.MODEL_KEYS).alias("model"),
        first_non_empty(attrs, K.WORKFLOW_KEYS).alias("workflow"),
        first_non_empty(attrs, K.TASK_KEYS).alias("task"),
        first_non_empty(attrs, K.CONVERSATION_KEYS).alias("conversation_id"),
        is_llm_call(attrs).alias("is_llm_call"),
        is_tool_call(attrs).alias("is_tool_call"),
        first_uint32(attrs, K.PROMPT_TOKEN_KEYS).alias("prompt_tokens"),
        first_uint32(attrs, K.COMPLETION_TOKEN_KEYS).alias("completion_tokens"),
        first_uint32(attrs, K.TOTAL_TOKEN_KEYS).alias("total_tokens"),
        (F.size("prompts") > 0).alias("has_prompts"),
        (F.size("completions") > 0).alias("has_completions"),
        *map(F.col, as_they_are),
    ]


def normalize_spans(raw: DataFrame) -> DataFrame:
    """``spans_normalized`` rows from ``raw_spans`` rows.

    ``_ingest_id`` orders re-deliveries of a span; without one in the input all
    rows count as the same delivery.
    """
    ingest_id = F.col("_ingest_id") if "_ingest_id" in raw.columns else F.lit(0)
    # The message arrays get a projection of their own, so that the has_ flags
    # read them instead of building them again.
    return raw.select("*", *_message_columns()).select(
        *_normalized_columns(),
        ingest_id.cast("bigint").alias("_ingest_id"),
        timestamps.to_date(F.col("timestamp_ns")).alias("date"),
    )


@built_once
def _flagged_columns() -> list[Column]:
    return [
        messages.message_flags(F.col("prompts"), messages.PROMPT_FIELDS).alias("prompts"),
        messages.message_flags(F.col("completions"), messages.COMPLETION_FIELDS).alias("completions"),
    ]


def spans_view(normalized: DataFrame) -> DataFrame:
    """The read view: as stored, with first/last flags on the messages."""
    flagged = dict(zip(("prompts", "completions"), _flagged_columns()))
    return normalized.select(
        *(flagged.get(c, F.col(c)) for c in normalized.columns if c != "_ingest_id")
    )
