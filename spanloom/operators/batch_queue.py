"""Queue of batched model requests: enqueue, run, follow, close.

All three tables only ever grow; the state of a batch is its newest event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.latest import latest_batches, limit_by

Client = Callable[[str, str, str, str], str]
"""``client(model_id, prompt, params, tool_config) -> response``"""

REQUEST_COLUMNS = ("batch_id", "row_id", "model_id", "prompt", "params", "tool_config")
ROW = ["batch_id", "row_id"]
ANSWER_SCHEMA = "batch_id string, row_id string, response string, status string, error string"


def pending_batches(batches: DataFrame) -> DataFrame:
    return latest_batches(batches).where(F.col("status") == "pending")


def in_pending_batches(
    rows: DataFrame, batches: DataFrame, broadcast_limit: int = 100_000, salts: int = 64
) -> DataFrame:
    """Rows (inputs or results) of the batches that are still pending.

    Usually few batches are, so their ids are counted first (a read of the
    small batch table) and, up to ``broadcast_limit``, sent to every task: the
    rows are then filtered where they are read. Beyond that the rows are
    shuffled; as one batch can hold a large share of them, each batch is spread
    over ``salts`` keys and the list of batches repeated once per salt.
    """
    wanted = pending_batches(batches).select("batch_id")
    if wanted.limit(broadcast_limit + 1).count() <= broadcast_limit:
        return rows.join(F.broadcast(wanted), "batch_id", "left_semi")
    salted_batches = wanted.select(
        "batch_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    )
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    return salted_rows.join(salted_batches, ["batch_id", "_salt"], "left_semi").drop("_salt")


def pending_inputs(inputs: DataFrame, batches: DataFrame, broadcast_limit: int = 100_000) -> DataFrame:
    return in_pending_batches(inputs, batches, broadcast_limit)


def unanswered_inputs(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Inputs without a result yet, so that a repeated run does no work twice."""
    return inputs.join(results, ["batch_id", "row_id"], "left_anti")


def run_batches(
    inputs: DataFrame,
    batches: DataFrame,
    results: DataFrame,
    client: Client,
    partitions: int | None = None,
) -> DataFrame:
    """Answers to every pending, unanswered input, for ``llm_results``.

    ``client`` is called once per (batch_id, row_id), however often the input
    was enqueued; an exception becomes a ``failed`` row. The requests are
    shuffled once, for all steps on these keys.
    ``partitions`` is the number of tasks the calls are spread over (the
    session's shuffle partitions if not given). It is fixed, because the calls
    take long however few bytes there are. Write the answers before using them
    twice: each evaluation calls the client again.
    """
    if partitions is None:
        partitions = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return answered(work_list(inputs, batches, results, partitions), client)


def work_list(inputs: DataFrame, batches: DataFrame, results: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every pending, unanswered request once (REQUEST_COLUMNS), distributed by row."""
    # Told apart by a digest that is made before the shuffle: who asks for the ids alone moves no prompts.
    pending = pending_inputs(inputs, batches).withColumn("_digest", _digest())
    pending = pending.repartition(*ROW) if partitions is None else pending.repartition(partitions, *ROW)
    return limit_by(unanswered_inputs(pending, results), 1, ROW, _first_input(inputs)).select(*REQUEST_COLUMNS)


def answered(requests: DataFrame, client: Client) -> DataFrame:
    """What the client says to each request, as rows for ``llm_results``."""

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                [_answer_row(client, row) for row in frame.itertuples(index=False)],
                columns=["batch_id", "row_id", "response", "status", "error"],
            )

    return requests.mapInPandas(answer, ANSWER_SCHEMA).withColumn(
        "created_at", F.current_timestamp()
    )


def _answer_row(client: Client, row) -> tuple[str, str, str, str, str]:
    try:
        response = client(row.model_id, row.prompt, row.params, row.tool_config)
        return row.batch_id, row.row_id, response, "complete", ""
    except Exception as problem:  # any client error is a failed row, not a failed job
        return row.batch_id, row.row_id, "", "failed", f"{type(problem).__name__}: {problem}"


def live_claims(claims: DataFrame, at: Column) -> DataFrame:
    """Of each row the claim that holds ``at`` that instant: the first made of those not expired."""
    holds = (F.col("claimed_at") <= at) & (F.col("expires_at") > at)
    return limit_by(claims.where(holds), 1, ROW, [F.asc("claimed_at"), F.asc("worker")])


def unclaimed(requests: DataFrame, claims: DataFrame, at: Column) -> DataFrame:
    """Requests that no worker holds at that instant; those whose claim expired are free again."""
    return requests.join(live_claims(claims, at).select(*ROW), ROW, "left_anti")


def new_claims(requests: DataFrame, worker: str, rows: int, at: Column, lease_seconds: int) -> DataFrame:
    """Claims of ``worker`` on ``rows`` requests; each worker goes through them in an order of its own, so that few meet."""
    own_order = F.xxhash64(F.lit(worker), *ROW)
    chosen = requests.select(*ROW).orderBy(own_order, *ROW).limit(rows)
    return chosen.select(
        *ROW,
        F.lit(worker).alias("worker"),
        at.alias("claimed_at"),
        (at + F.make_dt_interval(secs=F.lit(lease_seconds))).alias("expires_at"),
    )


def _first_input(inputs: DataFrame) -> list[Column]:
    """Order in which repeated inputs are preferred: the earliest, else any fixed one."""
    made = [F.asc("created_at")] if "created_at" in inputs.columns else []
    return [*made, F.asc("_digest")]


def _digest() -> Column:
    return F.xxhash64("model_id", "prompt", "params", "tool_config")


def batch_progress(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """Rows per batch: total, completed, failed.

    Rows are told by (batch_id, row_id): an input enqueued twice counts once, a
    row answered more than once counts once, by its newest result, and results
    without an input do not count.
    """
    current = limit_by(results, 1, ROW, [F.desc("created_at"), F.asc("status")])
    rows = inputs.select(*ROW).distinct().join(current.select(*ROW, "status"), ROW, "left")
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("status") == "complete").alias("completed_rows"),
        F.count_if(F.col("status") == "failed").alias("failed_rows"),
    )


def closing_events(
    inputs: DataFrame, batches: DataFrame, results: DataFrame, at: Column | None = None
) -> DataFrame:
    """``complete`` events for the pending batches whose inputs all have results.

    Only rows of pending batches are counted, not the whole history.
    """
    progress = batch_progress(
        in_pending_batches(inputs, batches), in_pending_batches(results, batches)
    )
    done = progress.where(F.col("completed_rows") + F.col("failed_rows") == F.col("total_rows"))
    return done.select(
        "batch_id",
        F.lit("complete").alias("status"),
        "total_rows",
        "completed_rows",
        "failed_rows",
        (F.current_timestamp() if at is None else at).alias("created_at"),
    )


def pending_events(inputs: DataFrame, at: Column | None = None) -> DataFrame:
    """The ``pending`` event each new batch starts with."""
    zero = F.lit(0).cast("bigint")
    distinct = inputs.select(*ROW).distinct()
    return distinct.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total_rows")).select(
        "batch_id",
        F.lit("pending").alias("status"),
        "total_rows",
        zero.alias("completed_rows"),
        zero.alias("failed_rows"),
        (F.current_timestamp() if at is None else at).alias("created_at"),
    )
