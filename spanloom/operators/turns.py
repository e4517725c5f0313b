"""Root span -> conversation turn. Row-wise, so it also runs in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import attribute_keys as K
from spanloom.functions.attributes import string_attr, without_keys
from spanloom.functions.conversation_json import agent_response, user_input
from spanloom.functions.reuse import built_once
from spanloom.operators.filters import has_attribute

HEAVY_KEYS = (K.ENTITY_INPUT, K.ENTITY_OUTPUT)


def is_root() -> Column:
    return F.col("parent_span_id") == ""


def in_conversation() -> Column:
    return F.col("conversation_id") != ""


def carries_turn() -> Column:
    """Either the input or the output payload is enough."""
    keys = F.col("span_attributes_keys")
    return has_attribute(keys, K.ENTITY_INPUT) | has_attribute(keys, K.ENTITY_OUTPUT)


@built_once
def _turn_columns() -> list[Column]:
    attrs = F.col("span_attributes")
    said = user_input(string_attr(attrs, K.ENTITY_INPUT))
    answered = agent_response(string_attr(attrs, K.ENTITY_OUTPUT))
    return [
        *map(F.col, ("service_name", "conversation_id", "trace_id")),
        F.col("start_ns").alias("turn_ns"),
        F.col("start_time").alias("turn_start"),
        F.coalesce(said, F.lit("")).alias("user_input"),
        F.coalesce(answered, F.lit("")).alias("agent_response"),
        without_keys(attrs, HEAVY_KEYS).alias("span_attributes"),
        *map(
            F.col,
            ("span_attributes_keys", "prompt_tokens", "completion_tokens", "status_code", "workflow",
             "_ingest_id", "date"),
        ),
    ]


def to_turns(normalized: DataFrame) -> DataFrame:
    """One row per root span that belongs to a conversation.

    Tokens and status are the root span's own, not totals over its trace. The
    two payload attributes are dropped from the stored map; the key array
    still names them.
    """
    return normalized.where(is_root() & in_conversation() & carries_turn()).select(
        *_turn_columns()
    )
