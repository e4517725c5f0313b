"""One append per stored table. Columns are matched by name; see ``Store.append``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources import tables
from spanloom.sources.tables import Store


def write_raw_spans(store: Store, df: DataFrame) -> None:
    store.append(df, tables.RAW_SPANS)


def write_trace_bounds(store: Store, df: DataFrame) -> None:
    """Partial bounds of one block; reads merge them."""
    store.append(df, tables.TRACE_BOUNDS)


def write_spans(store: Store, df: DataFrame) -> None:
    store.append(df, tables.SPANS_NORMALIZED)


def write_turns(store: Store, df: DataFrame) -> None:
    store.append(df, tables.TURNS)


def write_rejects(store: Store, df: DataFrame) -> None:
    """What could not be read or dated: columns ``reject_reason`` and ``reject_text``."""
    renamed = df.select(F.col("reject_reason").alias("reason"), F.col("reject_text").alias("text"), "_ingest_id")
    store.append(renamed, tables.OTLP_REJECTS)


def append_llm_inputs(store: Store, df: DataFrame) -> None:
    store.append(df, tables.LLM_INPUTS)


def append_llm_results(store: Store, df: DataFrame) -> None:
    """``status`` must be ``complete`` or ``failed``."""
    store.append(df, tables.LLM_RESULTS)


def append_llm_batches(store: Store, df: DataFrame) -> None:
    """``status`` must be ``pending`` or ``complete``."""
    store.append(df, tables.LLM_BATCHES)


def append_eval_scores(store: Store, df: DataFrame) -> None:
    store.append(df, tables.EVAL_SCORES)


def append_cluster_assignments(store: Store, df: DataFrame) -> None:
    store.append(df, tables.CLUSTER_ASSIGNMENTS)
