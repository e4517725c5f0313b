"""The stored tables: schema, layout, defaults, and the one way to append.

Plain Parquet tables, partitioned by day: what expires row by row is rewritten
a day at a time, and never the day still appended to. Appends rebalance rows by
partition value (so a day that holds most of a load is split over many tasks
and a small one gets one file) and sort inside each file by the columns reads
filter on, which makes Parquet's min/max statistics selective.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import timestamps
from spanloom.session import remove_folder, shared_dir, shuffles_dropped

ATTRS = "MAP<STRING, VARIANT>"
EVENTS = f"ARRAY<STRUCT<timestamp_ns: BIGINT, name: STRING, attributes: {ATTRS}>>"
LINKS = f"ARRAY<STRUCT<trace_id: STRING, span_id: STRING, trace_state: STRING, attributes: {ATTRS}>>"
PROMPTS = "ARRAY<STRUCT<message: STRING, position: BIGINT, role: STRING>>"
TOOL_CALLS = "ARRAY<STRUCT<id: STRING, name: STRING, arguments: STRING>>"
COMPLETIONS = (
    f"ARRAY<STRUCT<message: STRING, position: BIGINT, role: STRING, tool_calls: {TOOL_CALLS}>>"
)
PARTITION = "date"
"""Every table's partition column: the day of its clock."""
UUID_PATTERN = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, str]
    clock: str
    """Column that says when a row was made: BIGINT ns or TIMESTAMP."""
    order: tuple[str, ...]
    identity: tuple[str, ...] = ()
    """Columns that tell apart rows of one minute, but for repeats."""
    bloom: tuple[str, ...] = ()
    defaults: dict[str, Column | str | int] = field(default_factory=dict)
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    uuids: tuple[str, ...] = ()
    uint32: tuple[str, ...] = ()
    """Columns that hold 0 to 2^32 - 1."""
    whole_partitions: bool = False
    """Expired rows leave with their whole day, not one by one."""
    expires_by_day: bool = False
    """Age counts from the row's day, not from its instant."""
    follows_retention_setting: bool = True

    def clock_ns(self) -> Column:
        column = F.col(self.clock)
        return column if self.columns[self.clock] == "BIGINT" else timestamps.from_timestamp(column)

    def partition_value(self) -> Column:
        return timestamps.to_date(self.clock_ns())

    def ddl(self, database: str) -> str:
        columns = ", ".join(f"`{n}` {t}" for n, t in self.columns.items())
        # Adaptive: sized by the ids in the file, not 1 MB per column and file,
        # which would outweigh the data of small micro-batches.
        options = {"compression": "zstd", "parquet.bloom.filter.adaptive.enabled": "true"} | {
            f"parquet.bloom.filter.enabled#{c}": "true" for c in self.bloom
        }
        option_list = ", ".join(f"'{k}'='{v}'" for k, v in options.items())
        return (
            f"CREATE TABLE IF NOT EXISTS `{database}`.`{self.name}` "
            f"({columns}, `{PARTITION}` DATE) USING parquet "
            f"OPTIONS ({option_list}) PARTITIONED BY (`{PARTITION}`)"
        )


RAW_SPANS = Table(
    name="raw_spans",
    columns={
        "timestamp_ns": "BIGINT",
        "trace_id": "STRING",
        "span_id": "STRING",
        "parent_span_id": "STRING",
        "trace_state": "STRING",
        "span_name": "STRING",
        "span_kind": "STRING",
        "service_name": "STRING",
        "resource_attributes": ATTRS,
        "resource_attributes_keys": "ARRAY<STRING>",
        "scope_name": "STRING",
        "scope_version": "STRING",
        "span_attributes": ATTRS,
        "span_attributes_keys": "ARRAY<STRING>",
        "duration_ns": "BIGINT",
        "status_code": "STRING",
        "status_message": "STRING",
        "events": EVENTS,
        "links": LINKS,
        "_ingest_id": "BIGINT",
    },
    clock="timestamp_ns",
    order=("service_name", "span_name", "timestamp_ns"),
    bloom=("trace_id",),
    defaults={"_ingest_id": None},
    whole_partitions=True,
    expires_by_day=True,
)

TRACE_BOUNDS = Table(
    name="trace_bounds",
    columns={
        "trace_id": "STRING",
        "first_start_ns": "BIGINT",
        "last_start_ns": "BIGINT",
        "_ingest_id": "BIGINT",
    },
    clock="first_start_ns",
    order=("trace_id", "first_start_ns"),
    bloom=("trace_id",),
    defaults={"_ingest_id": None},
    whole_partitions=True,
    expires_by_day=True,
)

SPANS_NORMALIZED = Table(
    name="spans_normalized",
    columns={
        "service_name": "STRING",
        "trace_id": "STRING",
        "span_id": "STRING",
        "parent_span_id": "STRING",
        "span_name": "STRING",
        "start_ns": "BIGINT",
        "end_ns": "BIGINT",
        "duration_ns": "BIGINT",
        "start_time": "TIMESTAMP",
        "end_time": "TIMESTAMP",
        "status_code": "SMALLINT",
        "status_message": "STRING",
        "exception_type": "STRING",
        "exception_message": "STRING",
        "model": "STRING",
        "workflow": "STRING",
        "task": "STRING",
        "conversation_id": "STRING",
        "is_llm_call": "BOOLEAN",
        "is_tool_call": "BOOLEAN",
        "prompt_tokens": "BIGINT",
        "completion_tokens": "BIGINT",
        "total_tokens": "BIGINT",
        "has_prompts": "BOOLEAN",
        "has_completions": "BOOLEAN",
        "resource_attributes": ATTRS,
        "resource_attributes_keys": "ARRAY<STRING>",
        "span_attributes": ATTRS,
        "span_attributes_keys": "ARRAY<STRING>",
        "events": EVENTS,
        "links": LINKS,
        "prompts": PROMPTS,
        "completions": COMPLETIONS,
        "_ingest_id": "BIGINT",
    },
    clock="start_ns",
    order=("service_name", "start_ns", "trace_id", "span_id"),
    identity=("service_name", "trace_id", "span_id"),
    bloom=("trace_id", "span_id", "conversation_id"),
    whole_partitions=True,
)

TURNS = Table(
    name="conversations_normalized",
    columns={
        "service_name": "STRING",
        "conversation_id": "STRING",
        "trace_id": "STRING",
        "turn_ns": "BIGINT",
        "turn_start": "TIMESTAMP",
        "user_input": "STRING",
        "agent_response": "STRING",
        "span_attributes": ATTRS,
        "span_attributes_keys": "ARRAY<STRING>",
        "prompt_tokens": "BIGINT",
        "completion_tokens": "BIGINT",
        "status_code": "SMALLINT",
        "workflow": "STRING",
        "_ingest_id": "BIGINT",
    },
    clock="turn_ns",
    order=("service_name", "turn_ns", "conversation_id", "trace_id"),
    identity=("service_name", "conversation_id", "trace_id"),
    bloom=("conversation_id",),
    whole_partitions=True,
)

LLM_INPUTS = Table(
    name="llm_inputs",
    columns={
        "batch_id": "STRING",
        "row_id": "STRING",
        "model_id": "STRING",
        "prompt": "STRING",
        "params": "STRING",
        "tool_config": "STRING",
        "created_at": "TIMESTAMP",
    },
    clock="created_at",
    order=("batch_id", "row_id"),
    bloom=("batch_id",),
    defaults={"params": "{}", "tool_config": "", "created_at": F.current_timestamp},
    uuids=("batch_id", "row_id"),
    follows_retention_setting=False,
)

LLM_RESULTS = Table(
    name="llm_results",
    columns={
        "batch_id": "STRING",
        "row_id": "STRING",
        "response": "STRING",
        "status": "STRING",
        "error": "STRING",
        "created_at": "TIMESTAMP",
    },
    clock="created_at",
    order=("batch_id", "row_id"),
    bloom=("batch_id",),
    defaults={"error": "", "created_at": F.current_timestamp},
    allowed={"status": ("complete", "failed")},
    uuids=("batch_id", "row_id"),
    follows_retention_setting=False,
)

LLM_CLAIMS = Table(
    name="llm_claims",
    columns={
        "batch_id": "STRING",
        "row_id": "STRING",
        "worker": "STRING",
        "claimed_at": "TIMESTAMP",
        "expires_at": "TIMESTAMP",
    },
    clock="claimed_at",
    order=("batch_id", "row_id", "claimed_at"),
    bloom=("batch_id",),
    uuids=("batch_id", "row_id"),
    follows_retention_setting=False,
)
"""Which worker has taken which request, and until when; only ever grows."""

LLM_BATCHES = Table(
    name="llm_batches",
    columns={
        "batch_id": "STRING",
        "status": "STRING",
        "total_rows": "BIGINT",
        "completed_rows": "BIGINT",
        "failed_rows": "BIGINT",
        "created_at": "TIMESTAMP",
    },
    clock="created_at",
    order=("batch_id", "created_at"),
    defaults={
        "total_rows": 0,
        "completed_rows": 0,
        "failed_rows": 0,
        "created_at": F.current_timestamp,
    },
    allowed={"status": ("pending", "complete")},
    uuids=("batch_id",),
    uint32=("total_rows", "completed_rows", "failed_rows"),
    follows_retention_setting=False,
)

EVAL_SCORES = Table(
    name="conversation_eval_scores",
    columns={
        "monitor_uuid": "STRING",
        "service_name": "STRING",
        "conversation_id": "STRING",
        "eval_type": "STRING",
        "score": "DOUBLE",
        "reasoning": "STRING",
        "batch_id": "STRING",
        "scored_at": "TIMESTAMP",
    },
    clock="scored_at",
    order=("service_name", "conversation_id", "monitor_uuid", "eval_type"),
    uuids=("monitor_uuid", "batch_id"),
)

CLUSTER_ASSIGNMENTS = Table(
    name="conversation_cluster_assignments",
    columns={
        "space_uuid": "STRING",
        "service_name": "STRING",
        "conversation_id": "STRING",
        "taxonomy_version": "BIGINT",
        "cluster_key": "STRING",
        "predicted_cluster_key": "STRING",
        "confidence": "FLOAT",
        "batch_id": "STRING",
        "classified_at": "TIMESTAMP",
    },
    clock="classified_at",
    order=("service_name", "conversation_id", "space_uuid"),
    uuids=("space_uuid", "batch_id"),
    uint32=("taxonomy_version",),
)

OTLP_REJECTS = Table(
    name="otlp_rejects",
    columns={
        "reason": "STRING",
        "text": "STRING",
        "arrived_at": "TIMESTAMP",
        "_ingest_id": "BIGINT",
    },
    clock="arrived_at",
    order=("reason", "arrived_at"),
    defaults={"arrived_at": F.current_timestamp, "_ingest_id": None},
    whole_partitions=True,
    expires_by_day=True,
)

INGEST_BLOCKS = Table(
    name="ingest_blocks",
    columns={
        "number": "BIGINT",
        "source": "STRING",
        "epoch": "BIGINT",
        "status": "STRING",
        "spans": "BIGINT",
        "rejected": "BIGINT",
        "noted_at": "TIMESTAMP",
    },
    clock="noted_at",
    order=("number", "noted_at"),
    defaults={"noted_at": F.current_timestamp},
    allowed={"status": ("begun", "stored", "abandoned")},
)
"""Says which rows of the other tables count, so it does not expire."""

TABLES = {
    t.name: t
    for t in (
        RAW_SPANS,
        TRACE_BOUNDS,
        SPANS_NORMALIZED,
        TURNS,
        LLM_INPUTS,
        LLM_RESULTS,
        LLM_BATCHES,
        LLM_CLAIMS,
        EVAL_SCORES,
        CLUSTER_ASSIGNMENTS,
        OTLP_REJECTS,
    )
}
"""Tables that retention applies to."""


def with_defaults(df: DataFrame, table: Table) -> DataFrame:
    """Fill absent and NULL cells of the columns that have a default."""
    for name, default in table.defaults.items():
        value = default() if callable(default) else F.lit(default)
        value = value.cast(table.columns[name])
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def _check(column: Column, valid: Column, what: str) -> Column:
    """The column itself; a row that breaks the rule fails the write."""
    problem = F.concat(F.lit(what + ": "), F.coalesce(column.cast("string"), F.lit("NULL")))
    return F.when(F.coalesce(valid, F.lit(False)), column).otherwise(F.raise_error(problem))


def checked(df: DataFrame, table: Table) -> DataFrame:
    """Enforce the allowed values, the UUID form and the number range.

    UUIDs compare by value: they are stored in lower case.
    """
    checks = {
        name: _check(F.col(name), F.col(name).isin(*values), f"{table.name}.{name} not allowed")
        for name, values in table.allowed.items()
    } | {
        name: F.lower(_check(F.col(name), F.col(name).rlike(UUID_PATTERN), f"{table.name}.{name} not a UUID"))
        for name in table.uuids
    } | {
        name: _check(F.col(name), F.col(name).between(0, 2**32 - 1), f"{table.name}.{name} out of range")
        for name in table.uint32
    }
    return df.withColumns(checks) if checks else df


_APPENDING = threading.Lock()


class Store:
    """The tables of one database."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark = spark
        self.database = database
        self.location = location

    def ensure_tables(self) -> Store:
        """Create whatever is missing; safe to repeat."""
        place = f" LOCATION '{self.location}'" if self.location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}`{place}")
        for table in (*TABLES.values(), INGEST_BLOCKS):
            self.spark.sql(table.ddl(self.database))
        return self

    def folder(self) -> str:
        """Where the database lies."""
        return self.spark.catalog.getDatabase(self.database).locationUri.rstrip("/")

    def table_folder(self, table: Table) -> str:
        return f"{self.folder()}/{table.name}"

    def table_name(self, table: Table) -> str:
        return f"`{self.database}`.`{table.name}`"

    def read(self, table: Table) -> DataFrame:
        return self.spark.table(self.table_name(table))

    def append(self, df: DataFrame, table: Table) -> None:
        """Append rows by column name. Streams and workers of one application take turns:
        a job that ends removes the folder for temporary files that all jobs on a table share.
        """
        rows = self.laid_out(df, table)
        with _APPENDING, shuffles_dropped(rows.sparkSession):
            rows.write.insertInto(self.table_name(table))

    def replace_partition(self, df: DataFrame, table: Table, value: str) -> None:
        """Replace one partition by ``df``, which may derive from it.

        The rows are written to the shared folder first: a table cannot be
        overwritten while it is being read, and the replacement must not depend
        on files it deletes.
        """
        staging = f"{shared_dir(self.spark)}/spanloom/staging/{uuid.uuid4().hex}"
        try:
            df.select(*table.columns).write.parquet(staging)
            rows = self.laid_out(self.spark.read.parquet(staging), table).drop(PARTITION)
            self.spark.sql(
                f"INSERT OVERWRITE TABLE {self.table_name(table)} "
                f"PARTITION (`{PARTITION}` = DATE'{value}') SELECT * FROM {{rows}}",
                rows=rows,
            )
        finally:
            remove_folder(self.spark, staging)

    def laid_out(self, df: DataFrame, table: Table) -> DataFrame:
        rows = checked(with_defaults(df, table), table)
        selected = rows.select(
            *(F.col(n).cast(t).alias(n) if "VARIANT" not in t else F.col(n)
              for n, t in table.columns.items()),
            table.partition_value().alias(PARTITION),
        )
        return selected.hint("rebalance", PARTITION).sortWithinPartitions(
            PARTITION, *table.order
        )

    def partitions(self, table: Table) -> list[str]:
        rows = self.spark.sql(f"SHOW PARTITIONS {self.table_name(table)}").collect()
        return sorted(r.partition.split("=", 1)[1] for r in rows)

    def drop_partition(self, table: Table, value: str) -> None:
        self.spark.sql(
            f"ALTER TABLE {self.table_name(table)} "
            f"DROP IF EXISTS PARTITION (`{PARTITION}` = DATE'{value}')"
        )
