"""Ready-made reads over a store: what a client of the tables asks for."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions import timestamps
from spanloom.operators import annotations, batch_queue, conversations, filters, latest, normalize, traces
from spanloom.session import shared_dir
from spanloom.sources import blocks, days, tables
from spanloom.sources.tables import Store


def spans(store: Store, deduplicated: bool = True, first_ns: int | None = None, last_ns: int | None = None) -> DataFrame:
    """Stored spans of the four dialects. Compacted days come without a shuffle.

    Without ``deduplicated`` the deliveries not yet compacted come as they are.
    ``first_ns`` and ``last_ns``, both included, bound their starts; other days
    are not read, open or compacted.
    """
    dedup = latest.dedup_spans if deduplicated else lambda rows: rows
    rows = days.read(store, tables.SPANS_NORMALIZED, dedup)
    return normalize.spans_view(filters.in_range(rows, "start_ns", first_ns, last_ns))


def sampled_spans(store: Store, fraction: float, first_ns: int | None = None, last_ns: int | None = None) -> DataFrame:
    """Spans of a share of the traces, the same as ``filters.sample_traces`` takes.

    Compacted days are laid out by the hash that decides, so that row groups
    outside the share are not read.
    """
    narrow = lambda rows: rows.where(F.col(days.HASH) < filters.draw_limit(fraction))
    rows = days.read(store, tables.SPANS_NORMALIZED, latest.dedup_spans, narrow)
    return normalize.spans_view(filters.in_range(rows, "start_ns", first_ns, last_ns))


def spans_with_attribute(store: Store, key: str, value: str | None = None) -> DataFrame:
    """Spans that carry an attribute; of compacted days only files that may hold the key are read."""
    rows = days.read_with_key(store, tables.SPANS_NORMALIZED, latest.dedup_spans, key)
    return normalize.spans_view(filters.with_attribute(rows, key, value))


def compact(store: Store, before: dt.date) -> dict[str, dict[str, int]]:
    """Rewrite the days before ``before`` that have open files, each row once; and the ledger's."""
    done = {
        tables.SPANS_NORMALIZED.name: days.compact(store, tables.SPANS_NORMALIZED, latest.dedup_spans, before),
        tables.TURNS.name: days.compact(store, tables.TURNS, latest.dedup_turns, before),
    }
    blocks.fold(store, min(before, dt.datetime.now(dt.timezone.utc).date()))
    return done


def register_spans_view(store: Store, name: str = "spans") -> None:
    """Make the read view available to SQL."""
    spans(store).createOrReplaceTempView(name)


def turns(store: Store, first_ns: int | None = None, last_ns: int | None = None) -> DataFrame:
    """Stored turns, those of a time range where one is given; other days are not read."""
    return filters.in_range(days.read(store, tables.TURNS, latest.dedup_turns), "turn_ns", first_ns, last_ns)


def numbered_turns(store: Store, first_ns: int | None = None, last_ns: int | None = None) -> DataFrame:
    """Turns with their number in the whole conversation, so that a range spares no reading of earlier days."""
    # Numbering distributes the turns anyway; repeats go on the way. Later turns change no number.
    # Repeats of a turn share its minute, so whole minutes are kept until repeats are gone.
    minute = timestamps.NS_PER_MINUTE
    until = None if last_ns is None else (last_ns // minute + 1) * minute - 1
    rows = filters.in_range(days.read(store, tables.TURNS, lambda rows: rows), "turn_ns", None, until)
    return filters.in_range(conversations.number_deliveries(rows), "turn_ns", first_ns, last_ns)


def conversation_summary(store: Store, first_ns: int | None = None, last_ns: int | None = None) -> DataFrame:
    """One row per conversation, of its turns in the range."""
    return conversations.conversation_rollup(turns(store, first_ns, last_ns))


def clustered_conversations(store: Store) -> DataFrame:
    return annotations.with_clusters(
        conversation_summary(store), store.read(tables.CLUSTER_ASSIGNMENTS)
    )


def scored_conversations(store: Store) -> DataFrame:
    return annotations.with_eval_scores(
        conversation_summary(store), store.read(tables.EVAL_SCORES)
    )


def trace(store: Store, trace_id: str) -> DataFrame:
    seen = blocks.view(store)
    raw, bounds = (blocks.visible(store, t, seen) for t in (tables.RAW_SPANS, tables.TRACE_BOUNDS))
    return traces.fetch_trace(raw, bounds, trace_id)


def traces_of(store: Store, wanted: DataFrame) -> DataFrame:
    """Raw spans of all traces in ``wanted`` (column ``trace_id``); only days they touch are read."""
    seen = blocks.view(store)
    raw, bounds = (blocks.visible(store, t, seen) for t in (tables.RAW_SPANS, tables.TRACE_BOUNDS))
    return traces.fetch_traces(raw, bounds, wanted)


def rejects(store: Store) -> DataFrame:
    """What the ingest could not read or date, once per delivery."""
    return blocks.visible(store, tables.OTLP_REJECTS).select("reason", "text", "arrived_at")


def progress(store: Store) -> DataFrame:
    return batch_queue.batch_progress(
        store.read(tables.LLM_INPUTS), store.read(tables.LLM_RESULTS)
    )


def enqueue(store: Store, batch_id: str, rows: DataFrame) -> None:
    """Add the rows as one batch and, once stored, the event that makes it pending.

    After a failure in between no worker sees the rows; enqueue them again
    under a new id.
    """
    store.append(rows.withColumn("batch_id", F.lit(batch_id)), tables.LLM_INPUTS)
    # Counted from what was stored: running ``rows`` again could give others. The
    # batch's Bloom filters spare files without it.
    stored = store.read(tables.LLM_INPUTS).where(F.col("batch_id") == batch_id.lower())
    store.append(batch_queue.pending_events(stored), tables.LLM_BATCHES)


def work(
    store: Store, client: batch_queue.Client, partitions: int | None = None, wave_rows: int = 10_000
) -> None:
    """Answer everything that is pending, then close the finished batches.

    The rows are answered in waves of about ``wave_rows``, each stored before
    the next begins, so that a failure costs the answers of one wave only. What
    is to be done is worked out once and written by wave; inputs and results
    are not read again for each of them.
    """
    spark = store.spark
    inputs, batches = store.read(tables.LLM_INPUTS), store.read(tables.LLM_BATCHES)
    todo = batch_queue.work_list(inputs, batches, store.read(tables.LLM_RESULTS))
    # Hashed finely first; the waves are as many of these as fit one.
    place = f"{shared_dir(spark)}/spanloom/work/{uuid.uuid4().hex}"
    share = F.pmod(F.xxhash64(*batch_queue.ROW), F.lit(WORK_SHARES)).cast("int")
    spread = todo.withColumn("_share", share).repartition("_share").sortWithinPartitions("_share")
    spread.write.parquet(place)
    listed = spark.read.schema(spread.schema).parquet(place)
    for low, high in _waves({r["_share"]: r["count"] for r in listed.groupBy("_share").count().collect()}, wave_rows):
        wave = listed.where(F.col("_share").between(low, high)).drop("_share")
        many = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # The calls take long however few bytes there are.
        store.append(batch_queue.answered(wave.repartition(many, *batch_queue.ROW), client), tables.LLM_RESULTS)
    _close(store)


WORK_SHARES = 4096
"""Parts the work is divided into; a wave is one of them at least."""


def _waves(counts: dict[int, int], wave_rows: int) -> list[tuple[int, int]]:
    """Ranges of shares that hold ``wave_rows`` rows, or one share that holds more."""
    waves: list[list[int]] = []
    held = 0
    for share in sorted(counts):
        if waves and held + counts[share] <= wave_rows:
            waves[-1][1] = share
            held += counts[share]
        else:
            waves.append([share, share])
            held = counts[share]
    return [(low, high) for low, high in waves]


def _close(store: Store) -> None:
    inputs, batches = store.read(tables.LLM_INPUTS), store.read(tables.LLM_BATCHES)
    done = batch_queue.closing_events(inputs, batches, store.read(tables.LLM_RESULTS))
    store.append(done, tables.LLM_BATCHES)


def claim(store: Store, worker: str, rows: int, lease_seconds: int = 600, at: dt.datetime | None = None) -> DataFrame:
    """Take up to ``rows`` pending requests for ``worker``; those it holds, with their texts.

    A claim is a row; of several on one request the first by time, then worker,
    holds until it expires. Claims are stored first and read back then, so of
    workers that reach for the same request one gets it. After ``lease_seconds``
    others may take over. Should a slow worker answer all the same, both answers
    are stored and the newest counts.
    """
    now = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    inputs, batches, results = (store.read(t) for t in (tables.LLM_INPUTS, tables.LLM_BATCHES, tables.LLM_RESULTS))
    todo = batch_queue.work_list(inputs, batches, results)
    free = batch_queue.unclaimed(todo, store.read(tables.LLM_CLAIMS), now)
    store.append(batch_queue.new_claims(free, worker, rows, now, lease_seconds), tables.LLM_CLAIMS)
    later = F.current_timestamp() if at is None else now
    held = batch_queue.live_claims(store.read(tables.LLM_CLAIMS), later).where(F.col("worker") == worker)
    return todo.join(held.select(*batch_queue.ROW), batch_queue.ROW, "left_semi")


def work_claimed(store: Store, worker: str, client: batch_queue.Client, rows: int, lease_seconds: int = 600,
                 at: dt.datetime | None = None) -> int:
    """Claim, answer and store; returns how many requests were answered. 0: nothing is free, finished batches are closed."""
    place = f"{shared_dir(store.spark)}/spanloom/work/{uuid.uuid4().hex}"
    # Written before the calls: whether a claim holds must not be asked again later.
    claim(store, worker, rows, lease_seconds, at).write.parquet(place)
    mine = store.spark.read.parquet(place)
    many = mine.count()
    if many:
        # Called before the append, for which workers of one application take turns.
        answers = batch_queue.answered(mine.repartition(*batch_queue.ROW), client)
        answers.write.parquet(f"{place}-answers")
        store.append(store.spark.read.schema(answers.schema).parquet(f"{place}-answers"), tables.LLM_RESULTS)
    else:
        _close(store)
    return many


def work_stream(store: Store, worker: str, client: batch_queue.Client, checkpoint: str, rows: int = 1000,
                lease_seconds: int = 600, every: str | None = "2 seconds") -> StreamingQuery:
    """Work on whatever new batch events appear, until stopped (``every=None``: until what is there is done).

    Any number of such streams, under different names, may run at a time.
    """
    events = store.spark.readStream.schema(store.read(tables.LLM_BATCHES).schema).parquet(store.table_folder(tables.LLM_BATCHES))

    def answer(_: DataFrame, __: int) -> None:
        while work_claimed(store, worker, client, rows, lease_seconds):
            pass

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(answer)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
