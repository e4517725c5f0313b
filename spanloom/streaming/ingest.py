"""Continuous ingest: raw spans -> bounds, normalized spans, turns.

Each micro-batch is one block. The projections are row-wise and the bounds are
partial per block, so nothing carries state from one block to the next and no
watermark is needed; order-dependent work (turn numbers) is left to reads. The
ledger (``sources/blocks.py``) tells stored blocks from half-written ones.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions import timestamps
from spanloom.operators.normalize import normalize_spans
from spanloom.operators.traces import trace_bounds
from spanloom.operators.turns import to_turns
from spanloom.session import remove_folder, shared_dir, shuffles_dropped
from spanloom.sources import blocks, otlp, sinks
from spanloom.sources.tables import Store


@contextlib.contextmanager
def _staged(block: DataFrame) -> Iterator[DataFrame]:
    """The block's rows, worked out once, from a compressed table in the shared folder that goes with the block.

    A cached block takes some hundred times the disk, as its attribute maps are kept as they lie in memory.
    """
    spark = block.sparkSession
    place = f"{shared_dir(spark)}/spanloom/staging/{uuid.uuid4().hex}"
    try:
        with shuffles_dropped(spark):
            block.write.option("compression", "zstd").parquet(place)
        yield spark.read.schema(block.schema).parquet(place)
    finally:
        remove_folder(spark, place)


def write_block(store: Store, raw: DataFrame, epoch: int, source: str = "") -> int | None:
    """Write one block of raw spans and everything derived from it; returns its number.

    ``source`` and ``epoch`` say which block it is. One that is stored already
    is not written again (None). One that failed half-way is written anew under
    another number; what it left is hidden from reads. Turns derive from the
    block, not from deduplicated spans.

    Of rows that carry a ``reject_reason`` (see ``otlp.split_documents``) nothing
    is derived; they go to their own table.
    """
    number = blocks.begin(store, source, epoch)
    if number is None:
        return None
    with _staged(raw.withColumn("_ingest_id", F.lit(number).cast("bigint"))) as block:
        kept, rejected = block, None
        if otlp.REJECT_REASON in block.columns:
            rejected = block.where(F.col(otlp.REJECT_REASON).isNotNull())
            kept = block.where(F.col(otlp.REJECT_REASON).isNull()).drop(*otlp.REJECT_COLUMNS)
        sinks.write_raw_spans(store, kept)
        sinks.write_trace_bounds(store, trace_bounds(kept).withColumn("_ingest_id", F.lit(number)))
        normalized = normalize_spans(kept)
        sinks.write_spans(store, normalized)
        sinks.write_turns(store, to_turns(normalized))
        lost = 0
        if rejected is not None:
            lost = rejected.count()
            if lost:
                sinks.write_rejects(store, rejected)
        blocks.end(store, number, source, epoch, kept.count(), lost)
    return number


def start_ingest(
    stream: DataFrame,
    store: Store,
    checkpoint: str,
    every: str | None = "5 seconds",
) -> StreamingQuery:
    """Start ingesting ``stream`` into ``store``.

    ``every=None`` takes in what is there now and stops. A block is known by
    the id that the checkpoint gives the query, so that a new checkpoint begins
    with new blocks.
    """

    def write(block: DataFrame, epoch: int) -> None:
        write_block(store, block, epoch, _query_id(block, checkpoint))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def _query_id(block: DataFrame, checkpoint: str) -> str:
    """The id in the checkpoint's ``metadata`` file, which is written before the first block."""
    text = block.sparkSession.read.option("wholetext", True).text(f"{checkpoint}/metadata").first()
    return json.loads(text.value)["id"]


def closed_trace_bounds(stream: DataFrame, idle: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Bounds of traces, each emitted once it has been silent for ``idle``; append mode.

    State is one row per trace that is not closed yet, and ends with it: a
    session of the trace's spans closes when the watermark, ``late`` behind the
    newest span, has passed its end. Spans that come even later are not counted;
    a trace that goes on after it closed gets another row. Rows merge as the
    partial bounds of blocks do (``merge_trace_bounds``).
    """
    second = timestamps.whole_second(F.col("timestamp_ns"))
    return (
        stream.where(F.col("trace_id") != "")
        .select("trace_id", second.alias("_second"), timestamps.to_timestamp(F.col("timestamp_ns")).alias("_at"))
        .withWatermark("_at", late)
        .groupBy("trace_id", F.session_window("_at", idle))
        .agg(F.min("_second").alias("first_start_ns"), F.max("_second").alias("last_start_ns"))
        .select("trace_id", "first_start_ns", "last_start_ns")
    )


def dedup_redeliveries(stream: DataFrame, window: str = "30 minutes") -> DataFrame:
    """Drop exact re-deliveries of a span that arrive within ``window`` of the first.

    The watermark follows arrival, not the span's own time: a span that began
    long before others, or is exported late, is no repeat and stays, and the
    window only bounds how long a span is remembered. Keeps the first copy; use
    it only where copies are identical. As on read, a span is known by service,
    minute, trace and span id.
    """
    return (
        stream.withColumn("_arrived", F.current_timestamp())
        .withColumn("_minute", timestamps.to_minute(F.col("timestamp_ns")))
        .withWatermark("_arrived", window)
        .dropDuplicatesWithinWatermark(["service_name", "_minute", "trace_id", "span_id"])
        .drop("_arrived", "_minute")
    )
