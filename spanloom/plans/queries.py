"""One query per operator, each over whole tables.

Results are flat (no maps, arrays or variants) and hold integers, text and
flags only, so that they compare exactly with another engine's.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import timestamps
from spanloom.operators import (
    annotations,
    batch_queue,
    conversations,
    filters,
    latest,
    normalize,
    reads,
    retention,
    traces,
    turns,
)
from spanloom.session import shared_dir
from spanloom.sources import blocks, otlp, sinks, tables
from spanloom.sources import sample_traces as samples
from spanloom.sources.tables import Store
from spanloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.datetime(2024, 2, 10)
"""Fixed instant the retention queries look from."""
TTL_DAYS = 30
SCORE_TTL_DAYS = 40
SCORES_AS_OF = AS_OF + dt.timedelta(hours=2)


def _day(name: str = "date") -> Column:
    return F.col(name).cast("string").alias(name)


def _status() -> Column:
    return F.col("status_code").cast("int").alias("status_code")


def _seconds(name: str) -> Column:
    return F.unix_seconds(F.col(name)).alias(name)


def _percent() -> Column:
    return F.round(F.col("confidence") * 100).cast("int").alias("confidence_percent")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_spans(samples.raw_spans(spark, sf_dir))


def _turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.turn_spans(samples.table(spark, sf_dir, "conversations"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.to_turns(normalize.normalize_spans(_turn_spans(spark, sf_dir)))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_rollup(latest.dedup_turns(_turns(spark, sf_dir)))


# --- normalization ----------------------------------------------------------


def service_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and tokens per service and model."""
    return (
        _spans(spark, sf_dir)
        .groupBy("service_name", "model")
        .agg(
            F.count(F.lit(1)).alias("spans"),
            F.count_if(F.col("status_code") == 2).alias("failed"),
            F.sum("prompt_tokens").alias("prompt_tokens"),
            F.sum("completion_tokens").alias("completion_tokens"),
        )
    )


SCALARS = [
    "service_name", "trace_id", "span_id", "parent_span_id", "span_name", "start_ns", "end_ns",
    "duration_ns", _status, "status_message", "exception_type", "exception_message", "model",
    "workflow", "task", "conversation_id", "prompt_tokens", "completion_tokens", "total_tokens",
    _day,
]


def spans_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select(*(c if isinstance(c, str) else c() for c in SCALARS))


def llm_tool_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select(
        "span_id", "is_llm_call", "is_tool_call", "has_prompts", "has_completions"
    )


def _each(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """One row (``m``) per element. For a plain explode the optimizer adds a
    filter on the array's size and moves it below the projection that builds
    the array, which would then be built twice; the outer form is left alone."""
    return df.select(*keep, F.explode_outer(array).alias("m")).where(F.col("m").isNotNull())


def attribute_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        samples.raw_spans(spark, sf_dir)
        .select(F.explode_outer("span_attributes_keys").alias("attribute"))
        .where(F.col("attribute").isNotNull())
        .groupBy("attribute")
        .agg(F.count(F.lit(1)).alias("spans"))
    )


def prompts_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = normalize.spans_view(_spans(spark, sf_dir))
    return _each(view, "prompts", "span_id").select(
        "span_id", "m.position", "m.role", "m.message", "m.is_start", "m.is_end"
    )


def completions_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = normalize.spans_view(_spans(spark, sf_dir))
    return _each(view, "completions", "span_id").select(
        "span_id", "m.position", "m.role", "m.message", "m.is_start", "m.is_end",
        F.size("m.tool_calls").alias("calls"),
    )


def tool_calls_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = normalize.spans_view(_spans(spark, sf_dir))
    return (
        _each(view, "completions", "span_id")
        .select("span_id", "m.position", F.posexplode("m.tool_calls").alias("ordinal", "call"))
        .select("span_id", "position", "ordinal", "call.id", "call.name", "call.arguments")
    )


# --- sources and stored tables -----------------------------------------------


def otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = samples.spread(samples.table(spark, sf_dir, "events"), "event_id")
    documents = samples.otlp_documents(events)
    attrs = F.col("span_attributes")
    return otlp.parse_documents(documents).select(
        "service_name", "trace_id", "span_id", "span_name", "span_kind", "timestamp_ns",
        "duration_ns", "status_code", "status_message",
        F.size("span_attributes_keys").alias("attributes"),
        F.try_variant_get(attrs["gen_ai.request.model"], "$", "string").alias("model"),
        F.try_variant_get(attrs["gen_ai.usage.prompt_tokens"], "$", "bigint").alias("prompt_tokens"),
        F.try_variant_get(attrs["flag"], "$", "boolean").alias("flag"),
        F.try_variant_get(attrs["tags"], "$", "string").alias("tags"),
        F.try_variant_get(attrs["session.id"], "$", "string").alias("session_id"),
    )


def otlp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of documents of which some are cut off and some have a span without a start."""
    damaged = _damaged_documents(spark, sf_dir)
    kept = otlp.parse_documents(damaged).where("timestamp_ns > 0").select("span_id", F.lit("kept").alias("fate"))
    lost = otlp.rejected(damaged).select(F.regexp_extract("text", SPAN_IN_TEXT, 1).alias("span_id"), F.col("reason").alias("fate"))
    return kept.union(lost)


def _new_store(spark: SparkSession) -> tuple[Store, str]:
    """A store of its own in the shared folder, and a place for checkpoints."""
    run = uuid.uuid4().hex
    place = f"{shared_dir(spark)}/spanloom/{run}"
    return Store(spark, f"spanloom_{run}", f"{place}/tables").ensure_tables(), f"{place}/progress"


def _ingested(spark: SparkSession, sf_dir: str, place: tuple[Store, str] | None = None) -> Store:
    """The events as a file stream of spans, ingested to the end."""
    store, checkpoint = place or _new_store(spark)
    events = samples.table(spark, sf_dir, "events")
    # A pattern, as the table may be one file or a folder of files.
    arriving = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    arriving = arriving.where(F.input_file_name().rlike(r"/events\.parquet(/|$)"))
    many = samples.tasks_for(events)
    if events.rdd.getNumPartitions() < many:
        arriving = arriving.repartition(many, "event_id")
    ingest.start_ingest(
        samples.spans_from_events(arriving), store, checkpoint, every=None
    ).awaitTermination()
    return store


def streamed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.spans(_ingested(spark, sf_dir)).select(
        "service_name", "trace_id", "span_id", "start_ns", "end_ns", _status(), "model",
        "prompt_tokens", F.size("prompts").alias("prompts"),
        F.size("completions").alias("completions"), _day(),
    )


def streamed_trace_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.merge_trace_bounds(_ingested(spark, sf_dir).read(tables.TRACE_BOUNDS))


def closed_trace_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that a stream emits when traces close; the last span ends long after all others and stays open."""
    _, place = _new_store(spark)
    schema = samples.table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    arriving = arriving.where(F.input_file_name().rlike(r"/events\.parquet(/|$)"))
    spans = samples.spans_from_events(arriving).select("trace_id", "timestamp_ns")
    # A span of the far future for every thousandth one, so that time goes on.
    marks = F.when(_is_mark(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    marked = spans.withColumn("mark", F.explode(marks))
    spans = marked.select(
        F.when(F.col("mark"), "mark").otherwise(F.col("trace_id")).alias("trace_id"),
        (F.col("timestamp_ns") + F.when(F.col("mark"), 10**18).otherwise(0)).alias("timestamp_ns"),
    )
    writer = ingest.closed_trace_bounds(spans, "1 hour").writeStream.format("parquet")
    writer = writer.option("path", f"{place}-bounds").option("checkpointLocation", place)
    writer.trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema("trace_id string, first_start_ns bigint, last_start_ns bigint").parquet(f"{place}-bounds")
    return traces.merge_trace_bounds(closed.where("trace_id <> 'mark'"))


def _is_mark() -> Column:
    return F.pmod(F.xxhash64("trace_id", "timestamp_ns"), F.lit(1000)) == 0


def streamed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span delivered twice, in no order of time: each stays once, in the stream."""
    _, place = _new_store(spark)
    schema = samples.table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    arriving = arriving.where(F.input_file_name().rlike(r"/events\.parquet(/|$)"))
    twice = arriving.withColumn("delivery", F.explode(F.array(F.lit(0), F.lit(1)))).drop("delivery")
    spans = ingest.dedup_redeliveries(samples.spans_from_events(twice), "1 minute")
    writer = spans.select("trace_id", "span_id", "timestamp_ns").writeStream.format("parquet")
    writer = writer.option("path", f"{place}-spans").option("checkpointLocation", place)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}-spans")


def redelivered_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a backfill delivers late in its numbering, and a stream with a new checkpoint delivers again, corrected.

    The later delivery wins, although its epoch is smaller and its spans end
    earlier; the backfill's block, sent once more, changes nothing.
    """
    store, checkpoint = _new_store(spark)
    first = samples.raw_spans(spark, sf_dir).withColumns(
        {"duration_ns": F.col("duration_ns") * 2 + 1, "status_message": F.lit("first")}
    )
    ingest.write_block(store, first, 9, "backfill")
    _ingested(spark, sf_dir, (store, checkpoint))
    ingest.write_block(store, first, 9, "backfill")
    return reads.spans(store).select("trace_id", "span_id", "start_ns", "end_ns", "status_message")


def _event_number() -> Column:
    return F.conv("span_id", 16, 10).cast("bigint")


def _revised(spark: SparkSession, sf_dir: str, every: int, revision: int) -> DataFrame:
    raw = samples.raw_spans(spark, sf_dir).where(_event_number() % every == 0)
    return raw.withColumn("duration_ns", F.col("duration_ns") + revision)


def _compacted(spark: SparkSession, sf_dir: str) -> Store:
    """All spans, then every second one again, each compacted; then every eighth once more, which stays open."""
    store, _ = _new_store(spark)
    for revision, every in enumerate((1, 2, 8)):
        ingest.write_block(store, _revised(spark, sf_dir, every, revision), revision, "revisions")
        if revision < 2:
            reads.compact(store, dt.date.max)
    return store


def compacted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every span its last revision, from compacted days and what came after."""
    return reads.spans(_compacted(spark, sf_dir)).select(
        "service_name", "trace_id", "span_id", "start_ns", "end_ns", "model",
        F.size("prompts").alias("prompts"), _day(),
    )


def ranged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``compacted_spans``, the spans that begin in a time range."""
    return reads.spans(_compacted(spark, sf_dir), first_ns=RANGE_FIRST_NS, last_ns=RANGE_LAST_NS).select(
        "service_name", "trace_id", "span_id", "start_ns", "end_ns", "model",
        F.size("prompts").alias("prompts"), _day(),
    )


def ranged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a time range, with their numbers in whole conversations."""
    store, _ = _new_store(spark)
    for ingest_id in range(2):
        ingest.write_block(store, _turn_spans(spark, sf_dir), ingest_id)
    return reads.numbered_turns(store, TURNS_FIRST_NS, TURNS_LAST_NS).select(
        "service_name", "conversation_id", "trace_id", "turn", "turn_ns", _day()
    )


RANGE_FIRST_NS = 1_704_693_600_000_000_000
"""2024-01-08 06:00 UTC."""
RANGE_LAST_NS = 1_705_773_600_000_000_000
"""2024-01-20 18:00 UTC."""
TURNS_FIRST_NS = 1_704_067_500_000_000_000
"""2024-01-01 00:05 UTC."""
TURNS_LAST_NS = 1_704_068_160_500_000_000
"""2024-01-01 00:16:00.5 UTC."""


def attribute_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.spans_with_attribute(_compacted(spark, sf_dir), "openinference.span.kind", "TOOL")
    return found.select("span_id", "service_name", "model")


def sampled_traces_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.sampled_spans(_compacted(spark, sf_dir), 0.25).select("trace_id", "span_id")


def compacted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns delivered twice, compacted, and numbered."""
    store, _ = _new_store(spark)
    for epoch in range(2):
        ingest.write_block(store, _turn_spans(spark, sf_dir), epoch)
    reads.compact(store, dt.date.max)
    return reads.numbered_turns(store).select(
        "service_name", "conversation_id", "trace_id", "turn", "user_input", "agent_response", _day()
    )


def traces_fetched_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``failed_traces``, from a store partitioned by day."""
    store, _ = _new_store(spark)
    ingest.write_block(store, samples.raw_spans(spark, sf_dir), 0)
    roots = (F.col("parent_span_id") == "") & (F.col("status_code") == "Error")
    failed = store.read(tables.RAW_SPANS).where(roots).select("trace_id")
    return reads.traces_of(store, failed).select("trace_id", "span_id", "timestamp_ns", "status_code")


def _damaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some are cut off and some have a span without a start."""
    documents = samples.otlp_documents(samples.spread(samples.table(spark, sf_dir, "events"), "event_id"))
    kind = F.conv(F.regexp_extract("value", SPAN_IN_TEXT, 1), 16, 10).cast("bigint") % 7
    cut = F.expr("substr(value, 1, length(value) - 2)")
    unstarted = F.regexp_replace("value", '"startTimeUnixNano":"[0-9]+"', '"startTimeUnixNano":"soon"')
    return documents.select(F.when(kind == 0, cut).when(kind == 1, unstarted).otherwise(F.col("value")).alias("value"))


SPAN_IN_TEXT = r'"spanId":"([0-9a-f]{16})"'


def _streamed_documents(spark: SparkSession, sf_dir: str) -> Store:
    """Files of such documents, ingested as they lie there."""
    store, checkpoint = _new_store(spark)
    _damaged_documents(spark, sf_dir).write.text(f"{checkpoint}-documents")
    stream = otlp.stream_spans(spark, f"{checkpoint}-documents", rejects=True)
    ingest.start_ingest(stream, store, checkpoint, every=None).awaitTermination()
    return store


def streamed_otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a stream of documents; what can't be dated is not among them."""
    return reads.spans(_streamed_documents(spark, sf_dir)).select(
        "service_name", "trace_id", "span_id", "span_name", "start_ns", "end_ns", _status(), "model",
        "prompt_tokens", _day(),
    )


def streamed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each document of the stream, and what the ledger counted."""
    store = _streamed_documents(spark, sf_dir)
    kept = reads.spans(store).select("span_id", F.lit("kept").alias("fate"))
    lost = reads.rejects(store).select(F.regexp_extract("text", SPAN_IN_TEXT, 1).alias("span_id"), F.col("reason").alias("fate"))
    counted = blocks.counts(store).agg(F.sum("spans").alias("spans"), F.sum("rejected").alias("rejected"))
    totals = counted.select(F.concat_ws(" + ", "spans", "rejected").alias("span_id"), F.lit("counted").alias("fate"))
    return kept.union(lost).union(totals)


def stored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same block delivered twice leaves each turn once."""
    store, _ = _new_store(spark)
    for ingest_id in range(2):
        ingest.write_block(store, _turn_spans(spark, sf_dir), ingest_id)
    return reads.numbered_turns(store).select(
        "service_name", "conversation_id", "trace_id", "turn", "user_input", "agent_response", _day()
    )


def stored_raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spans after the expired days were dropped."""
    store, _ = _new_store(spark)
    sinks.write_raw_spans(store, samples.raw_spans(spark, sf_dir))
    retention.apply_retention(store, tables.RAW_SPANS, AS_OF, TTL_DAYS)
    return store.read(tables.RAW_SPANS).select("span_id", _day())


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scores after the expired rows were removed."""
    store, _ = _new_store(spark)
    sinks.append_eval_scores(store, samples.eval_scores(spark, sf_dir))
    retention.apply_retention(store, tables.EVAL_SCORES, SCORES_AS_OF, SCORE_TTL_DAYS)
    return store.read(tables.EVAL_SCORES).select(
        "conversation_id", "eval_type", "reasoning", _seconds("scored_at")
    )


def stored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored turns and labels, joined as a client reads them."""
    store, _ = _new_store(spark)
    sinks.write_turns(store, _turns(spark, sf_dir))
    sinks.append_cluster_assignments(store, samples.cluster_assignments(spark, sf_dir))
    return reads.clustered_conversations(store).select(
        "service_name", "conversation_id", "space_uuid", "cluster_key", "predicted_cluster_key",
        "turns", "status",
    )


def stored_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored requests, answers and events; progress per batch."""
    store, _ = _new_store(spark)
    sinks.append_llm_inputs(store, samples.queue_inputs(spark, sf_dir))
    sinks.append_llm_batches(store, samples.queue_batches(spark, sf_dir))
    sinks.append_llm_results(store, samples.queue_results(spark, sf_dir))
    return reads.progress(store)


def worked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue with repeated inputs, answers to nothing and ids in either case, worked off in waves."""
    store, _ = _new_store(spark)
    inputs, results = samples.queue_inputs(spark, sf_dir), samples.queue_results(spark, sf_dir)
    sinks.append_llm_inputs(store, inputs)
    sinks.append_llm_inputs(store, inputs.where(F.length("prompt") % 3 == 0))
    sinks.append_llm_batches(store, samples.queue_batches(spark, sf_dir))
    sinks.append_llm_results(store, results.withColumns({c: F.upper(c) for c in batch_queue.ROW}))
    foreign = F.concat(F.lit("f"), F.substring("row_id", 2, 35))
    sinks.append_llm_results(store, results.withColumn("row_id", foreign))
    todo = inputs.count()
    reads.work(store, digest_client, wave_rows=max(1, todo // 8))
    return latest.latest_batches(store.read(tables.LLM_BATCHES)).drop("created_at", tables.PARTITION)


def claimed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workers in turn, after a third took requests and was never seen again: every request has one answer."""
    store, _ = _new_store(spark)
    sinks.append_llm_inputs(store, samples.queue_inputs(spark, sf_dir))
    sinks.append_llm_batches(store, samples.queue_batches(spark, sf_dir))
    share = max(1, store.read(tables.LLM_INPUTS).count() // 4)
    reads.claim(store, "lost", share, 60, AS_OF)
    at, idle = AS_OF, 0
    while idle < 2:
        at += dt.timedelta(seconds=40)
        idle = sum(reads.work_claimed(store, w, digest_client, share, 60, at) == 0 for w in ("first", "second"))
    answers = F.count(F.lit(1)).over(Window.partitionBy("batch_id", "row_id")).alias("answers")
    return store.read(tables.LLM_RESULTS).select("batch_id", "row_id", "response", "status", answers)


def enqueued_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inputs as one batch: the event that makes it pending."""
    store, _ = _new_store(spark)
    rows = samples.queue_inputs(spark, sf_dir).drop("batch_id")
    reads.enqueue(store, "00000000-0000-4000-8000-0000000000AB", rows)
    return store.read(tables.LLM_BATCHES).select("batch_id", "status", "total_rows", "completed_rows", "failed_rows")


def stored_queue_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs left after 30 days, however short the retention setting is."""
    store, _ = _new_store(spark)
    sinks.append_llm_inputs(store, samples.queue_inputs(spark, sf_dir))
    as_of = dt.datetime(2024, 1, 1) + dt.timedelta(days=30, seconds=100)
    retention.apply_retention(store, tables.LLM_INPUTS, as_of, days=1)
    return store.read(tables.LLM_INPUTS).select("batch_id", "row_id", _seconds("created_at"))


# --- turns and conversations ---------------------------------------------------


def turn_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select(
        "service_name", "conversation_id", "trace_id", "turn_ns", "user_input", "agent_response",
        "prompt_tokens", "completion_tokens", _status(), "workflow",
        F.size("span_attributes_keys").alias("listed_keys"),
        F.size(F.map_keys("span_attributes")).alias("stored_keys"),
    )


def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.number_deliveries(_turns(spark, sf_dir)).select(
        "service_name", "conversation_id", "trace_id", "turn"
    )


def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir)


def workflow_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.in_workflow(_conversations(spark, sf_dir), "flow-1").select(
        "service_name", "conversation_id", "turns"
    )


def conversation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.find_conversation(_turns(spark, sf_dir), "c12").select("trace_id", "turn_ns")


def clusters_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.with_clusters(
        _conversations(spark, sf_dir), samples.cluster_assignments(spark, sf_dir)
    ).select(
        "service_name", "conversation_id", "space_uuid", "cluster_key", "predicted_cluster_key",
        "turns", "status",
    )


def scores_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.with_eval_scores(
        _conversations(spark, sf_dir), samples.eval_scores(spark, sf_dir)
    ).select(
        "service_name", "conversation_id", "monitor_uuid", "eval_type",
        F.col("score").cast("int").alias("score"), "reasoning", "turns",
    )


def early_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.annotations_before_turns(
        _conversations(spark, sf_dir), samples.eval_scores(spark, sf_dir), "scored_at"
    ).select("service_name", "conversation_id", "monitor_uuid", "eval_type", _seconds("scored_at"))


# --- latest wins -----------------------------------------------------------------


def _delivered_twice(rows: DataFrame) -> DataFrame:
    again = rows.withColumn("_ingest_id", F.lit(1).cast("bigint"))
    return rows.unionByName(again)


def dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    return latest.dedup_spans(_delivered_twice(spans)).select(
        "trace_id", "span_id", "start_ns", F.col("_ingest_id").alias("delivery")
    )


def dedup_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.dedup_turns(_delivered_twice(_turns(spark, sf_dir))).select(
        "conversation_id", "trace_id", "turn_ns", F.col("_ingest_id").alias("delivery")
    )


def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_eval_scores(samples.eval_scores(spark, sf_dir)).select(
        "service_name", "monitor_uuid", "conversation_id", "eval_type",
        F.col("score").cast("int").alias("score"), "reasoning", _seconds("scored_at"),
    )


def latest_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_cluster_assignments(samples.cluster_assignments(spark, sf_dir)).select(
        "service_name", "conversation_id", "space_uuid", "cluster_key", "predicted_cluster_key",
        _percent(), _seconds("classified_at"),
    )


def latest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_batches(samples.queue_batches(spark, sf_dir)).select(
        "batch_id", "status", "total_rows", "completed_rows", _seconds("created_at")
    )


# --- traces ------------------------------------------------------------------------


def trace_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial bounds of two blocks, roots and children, merged."""
    raw = samples.raw_spans(spark, sf_dir)
    roots = raw.where(F.col("parent_span_id") == "")
    children = raw.where(F.col("parent_span_id") != "")
    return traces.merge_trace_bounds(
        traces.trace_bounds(roots).unionByName(traces.trace_bounds(children))
    )


LOOKED_UP_EVENT = 101


def _looked_up_trace() -> str:
    return f"{LOOKED_UP_EVENT // 5:032x}"


def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = samples.raw_spans(spark, sf_dir)
    return filters.find_trace(spans, _looked_up_trace(), limit=5).select(
        "service_name", "span_name", "trace_id"
    )


def trace_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many spans of a trace as a limit lets pass, told by number."""
    found = filters.find_trace(samples.raw_spans(spark, sf_dir), _looked_up_trace(), limit=3)
    return found.agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("trace_id").alias("traces"))


def span_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = samples.raw_spans(spark, sf_dir)
    return filters.find_span(spans, f"{LOOKED_UP_EVENT:016x}").select(
        "service_name", "span_name", "span_id"
    )


def trace_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = samples.raw_spans(spark, sf_dir)
    return traces.fetch_trace(raw, traces.trace_bounds(raw), _looked_up_trace()).select(
        "span_id", "parent_span_id", "timestamp_ns"
    )


def failed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of the traces whose root failed."""
    raw = samples.raw_spans(spark, sf_dir)
    failed = raw.where(
        (F.col("parent_span_id") == "") & (F.col("status_code") == "Error")
    ).select("trace_id")
    return traces.fetch_traces(raw, traces.trace_bounds(raw), failed).select(
        "trace_id", "span_id", "timestamp_ns", "status_code"
    )


def trace_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_time_series(samples.raw_spans(spark, sf_dir), 600, "timestamp_ns")


def attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.with_attribute(_spans(spark, sf_dir), "openinference.span.kind", "TOOL")
    return found.select("span_id", "service_name", "model")


def turn_attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.with_attribute(_turns(spark, sf_dir), "traceloop.entity.output")
    return found.select("conversation_id", "trace_id")


def slow_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.duration_between(_spans(spark, sf_dir), 50_000_000, 100_000_000).select(
        "span_id", "duration_ns"
    )


def spans_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dt.datetime(2024, 1, 10, 12)
    return filters.started_between(
        _spans(spark, sf_dir), first, first + dt.timedelta(days=1)
    ).select("span_id", "start_ns", _day())


def sampled_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sample_traces(samples.raw_spans(spark, sf_dir), 0.25).select(
        "trace_id", "span_id"
    )


def failed_span_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.count_rows(samples.raw_spans(spark, sf_dir), "status_code = 'Error'")


# --- request queue ---------------------------------------------------------------------


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_defaults(samples.queue_inputs(spark, sf_dir), tables.LLM_INPUTS)


def queue_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.checked(_inputs(spark, sf_dir), tables.LLM_INPUTS).select(
        "batch_id", "row_id", "model_id", "params", "tool_config",
        F.length("prompt").alias("prompt_length"), _seconds("created_at"),
    )


def pending_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_queue.pending_inputs(
        _inputs(spark, sf_dir), samples.queue_batches(spark, sf_dir)
    ).select("batch_id", "row_id")


def unanswered_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_queue.unanswered_inputs(
        _inputs(spark, sf_dir), samples.queue_results(spark, sf_dir)
    ).select("batch_id", "row_id")


def digest_client(model_id: str, prompt: str, params: str, tool_config: str) -> str:
    """Stands in for a model: a digest of the request, refusing some prompts."""
    if len(prompt) % 10 == 0:
        raise ValueError("prompt refused")
    digest = hashlib.md5(prompt.encode()).hexdigest()
    return f"{model_id}|{params}|{tool_config}|{len(prompt)}|{digest}"


def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_queue.run_batches(
        _inputs(spark, sf_dir),
        samples.queue_batches(spark, sf_dir),
        samples.queue_results(spark, sf_dir),
        digest_client,
    ).select("batch_id", "row_id", "response", "status", "error")


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_queue.batch_progress(
        _inputs(spark, sf_dir), samples.queue_results(spark, sf_dir)
    )


def repeated_inputs_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress where a third of the inputs is enqueued twice and answers without an input lie about."""
    inputs, results = _inputs(spark, sf_dir), samples.queue_results(spark, sf_dir)
    foreign = F.concat(F.lit("f"), F.substring("row_id", 2, 35))
    return batch_queue.batch_progress(
        inputs.unionByName(inputs.where(F.length("prompt") % 3 == 0)),
        results.unionByName(results.withColumn("row_id", foreign)),
    )


def closed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_queue.closing_events(
        _inputs(spark, sf_dir),
        samples.queue_batches(spark, sf_dir),
        samples.queue_results(spark, sf_dir),
    ).drop("created_at")


def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_queue.pending_events(_inputs(spark, sf_dir)).drop("created_at")


# --- retention ----------------------------------------------------------------------------


def retained_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.in_kept_days(_spans(spark, sf_dir), TTL_DAYS, AS_OF).select("span_id", _day())


def unexpired_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = samples.eval_scores(spark, sf_dir)
    clock = timestamps.from_timestamp(F.col("scored_at"))
    return retention.unexpired(scores, clock, SCORE_TTL_DAYS, SCORES_AS_OF).select(
        "conversation_id", "eval_type", "reasoning", _seconds("scored_at")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        service_usage,
        spans_scalar,
        llm_tool_flags,
        attribute_key_counts,
        prompts_flat,
        completions_flat,
        tool_calls_flat,
        otlp_spans,
        otlp_rejects,
        streamed_spans,
        streamed_trace_bounds,
        streamed_dedup,
        closed_trace_bounds,
        streamed_otlp,
        streamed_rejects,
        redelivered_spans,
        compacted_spans,
        ranged_spans,
        ranged_turns,
        compacted_turns,
        attribute_search_stored,
        sampled_traces_stored,
        traces_fetched_stored,
        stored_turns,
        stored_raw_spans,
        stored_scores,
        stored_clusters,
        stored_progress,
        worked_queue,
        claimed_work,
        enqueued_batch,
        stored_queue_retained,
        turn_texts,
        turn_numbers,
        conversation_rollup,
        workflow_conversations,
        conversation_lookup,
        clusters_joined,
        scores_joined,
        early_annotations,
        dedup_spans,
        dedup_turns,
        latest_scores,
        latest_clusters,
        latest_batches,
        trace_bounds,
        trace_lookup,
        trace_limited,
        span_lookup,
        trace_fetch,
        failed_traces,
        trace_series,
        attribute_search,
        turn_attribute_search,
        slow_spans,
        spans_of_a_day,
        sampled_traces,
        failed_span_count,
        queue_inputs,
        pending_inputs,
        unanswered_inputs,
        batch_answers,
        batch_progress,
        repeated_inputs_progress,
        closed_batches,
        pending_events,
        retained_spans,
        unexpired_scores,
    )
}
