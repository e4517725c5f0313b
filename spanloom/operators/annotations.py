"""Eval scores and cluster labels of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import attribute_keys as K
from spanloom.functions import timestamps
from spanloom.operators.conversations import CONVERSATION
from spanloom.operators.latest import latest_cluster_assignments, latest_eval_scores


def cluster_key(predicted: Column, confidence: Column, min_confidence: float) -> Column:
    return F.when(confidence < min_confidence, K.UNCATEGORIZED).otherwise(predicted)


def gate_cluster_keys(assignments: DataFrame, min_confidence: float) -> DataFrame:
    """Set ``cluster_key`` from the raw pick, which stays beside it."""
    return assignments.withColumn(
        "cluster_key",
        cluster_key(F.col("predicted_cluster_key"), F.col("confidence"), min_confidence),
    )


def with_clusters(conversations: DataFrame, assignments: DataFrame) -> DataFrame:
    """Conversations with their current label in each space.

    Both sides are reduced first (one row per conversation, one per label), so
    the join never sees turns or outdated labels.
    """
    return conversations.join(latest_cluster_assignments(assignments), CONVERSATION)


def with_eval_scores(conversations: DataFrame, scores: DataFrame) -> DataFrame:
    """Conversations with their current scores; orphan scores do not show."""
    return conversations.join(latest_eval_scores(scores), CONVERSATION)


def annotations_before_turns(
    conversations: DataFrame, annotations: DataFrame, annotated_at: str
) -> DataFrame:
    """Annotations made before the first turn of their conversation.

    There should be none: annotations expire by their own time, and only ones
    that are younger than the conversation are sure to outlive it.
    """
    made_ns = timestamps.from_timestamp(F.col(annotated_at))
    return annotations.join(
        conversations.select(*CONVERSATION, "first_turn_ns"), CONVERSATION
    ).where(made_ns < F.col("first_turn_ns"))
