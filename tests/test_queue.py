from collections import Counter

from pyspark.sql import functions as F

from spanloom.operators import batch_queue, reads
from spanloom.sources import tables

INPUTS = "row_id string, model_id string, prompt string"


def uuid_of(n):
    return f"00000000-0000-4000-8000-{n:012x}"


def enqueue(store, batch, prompts):
    rows = [(uuid_of(batch * 1000 + i), "m", p) for i, p in enumerate(prompts)]
    reads.enqueue(store, uuid_of(batch), store.spark.createDataFrame(rows, INPUTS))


def client(model_id, prompt, params, tool_config):
    if prompt == "bad":
        raise RuntimeError("no")
    return f"{model_id}:{prompt}:{params}:{tool_config}"


def test_a_batch_from_pending_to_complete(store):
    enqueue(store, 1, ["a", "bad", "c"])
    enqueue(store, 2, ["d"])
    pending = store.read(tables.LLM_BATCHES).collect()
    assert {(r.batch_id, r.status, r.total_rows) for r in pending} == {
        (uuid_of(1), "pending", 3), (uuid_of(2), "pending", 1)
    }
    reads.work(store, client, partitions=3)
    results = {r.row_id: (r.status, r.response, r.error) for r in store.read(tables.LLM_RESULTS).collect()}
    assert results[uuid_of(1000)] == ("complete", "m:a:{}:", "")
    assert results[uuid_of(1001)] == ("failed", "", "RuntimeError: no")
    assert len(results) == 4
    progress = {r.batch_id: tuple(r)[1:] for r in reads.progress(store).collect()}
    assert progress == {uuid_of(1): (3, 2, 1), uuid_of(2): (1, 1, 0)}
    assert batch_queue.pending_batches(store.read(tables.LLM_BATCHES)).count() == 0

    reads.work(store, client)
    assert store.read(tables.LLM_RESULTS).count() == 4
    assert Counter(r.status for r in store.read(tables.LLM_BATCHES).collect()) == {"pending": 2, "complete": 2}


def test_only_unanswered_rows_of_a_half_done_batch_run_again(store):
    enqueue(store, 1, ["a", "b"])
    done = store.spark.createDataFrame(
        [(uuid_of(1), uuid_of(1000), "kept", "complete")],
        "batch_id string, row_id string, response string, status string",
    )
    store.append(done, tables.LLM_RESULTS)
    reads.work(store, client)
    got = {r.row_id: r.response for r in store.read(tables.LLM_RESULTS).collect()}
    assert got == {uuid_of(1000): "kept", uuid_of(1001): "m:b:{}:"}


def test_who_asks_for_ids_moves_no_prompts(store):
    enqueue(store, 1, ["a", "b"])
    todo = batch_queue.work_list(*(store.read(t) for t in (tables.LLM_INPUTS, tables.LLM_BATCHES, tables.LLM_RESULTS)))
    ids = todo.select(*batch_queue.ROW)
    assert sorted(r.row_id for r in ids.collect()) == [uuid_of(1000), uuid_of(1001)]
    plan = ids._jdf.queryExecution().sparkPlan().toString().splitlines()
    shuffle = next(i for i, l in enumerate(plan) if "REPARTITION_BY" in l)
    assert not any("prompt" in l for l in plan[:shuffle])


def test_a_hot_batch_is_spread_over_the_salts(spark):
    inputs = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("batch_id"),
        F.col("id").cast("string").alias("row_id"),
    )
    batches = spark.createDataFrame(
        [("hot", "pending", 0, 0, 0), ("b1", "pending", 0, 0, 0), ("b2", "complete", 0, 0, 0)],
        "batch_id string, status string, total_rows bigint, completed_rows bigint, failed_rows bigint",
    ).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    expected = Counter(
        b for b in ("hot" if i % 3 == 0 else f"b{i % 7}" for i in range(4000)) if b in ("hot", "b1")
    )
    for limit in (0, 1, 2, 100):
        found = batch_queue.pending_inputs(inputs, batches, broadcast_limit=limit)
        assert Counter(r.batch_id for r in found.collect()) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == (limit >= 2)


def test_calls_are_spread_over_a_fixed_number_of_tasks(spark):
    inputs = spark.createDataFrame(
        [], "batch_id string, row_id string, model_id string, prompt string, params string, tool_config string"
    )
    batches = spark.createDataFrame(
        [], "batch_id string, status string, total_rows bigint, completed_rows bigint,"
        " failed_rows bigint, created_at timestamp",
    )
    answers = batch_queue.run_batches(inputs, batches, inputs.select("batch_id", "row_id"), client, 3)
    assert ", 3), REPARTITION_BY_NUM" in answers._jdf.queryExecution().executedPlan().toString()


def test_progress_counts_each_row_once(spark):
    inputs = spark.createDataFrame([("b", "1"), ("b", "2"), ("c", "3")], "batch_id string, row_id string")
    results = spark.createDataFrame(
        [("b", "1", "failed", 1), ("b", "1", "complete", 2), ("b", "2", "failed", 1)],
        "batch_id string, row_id string, status string, created_at int",
    )
    got = {r.batch_id: tuple(r)[1:] for r in batch_queue.batch_progress(inputs, results).collect()}
    assert got == {"b": (2, 1, 1), "c": (1, 0, 0)}


def test_repeated_inputs_and_foreign_results_close_no_batch(spark):
    """An input enqueued twice counts once; an answer to nothing answers nothing."""
    inputs = spark.createDataFrame([("b", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "1")], "batch_id string, row_id string")
    results = spark.createDataFrame(
        [("b", "1", "complete", 1), ("b", "x", "complete", 1), ("b", "y", "failed", 1), ("c", "1", "complete", 1)],
        "batch_id string, row_id string, status string, created_at int",
    )
    batches = spark.createDataFrame(
        [("b", "pending", 2, 0, 0), ("c", "pending", 1, 0, 0)],
        "batch_id string, status string, total_rows bigint, completed_rows bigint, failed_rows bigint",
    ).withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    closed = batch_queue.closing_events(inputs, batches, results).collect()
    assert [(r.batch_id, r.total_rows, r.completed_rows) for r in closed] == [("c", 1, 1)]
    counted = {r.batch_id: r.total_rows for r in batch_queue.pending_events(inputs).collect()}
    assert counted == {"b": 2, "c": 1}


def test_a_failing_wave_keeps_earlier_answers(spark, store):
    ids = [f"{i:08x}-0000-0000-0000-000000000000" for i in range(12)]
    rows = spark.createDataFrame([(i, "m", "p") for i in ids], "row_id string, model_id string, prompt string")
    reads.enqueue(store, ids[0].replace("0-", "A-"), rows)
    waves = []

    class Broken(BaseException):
        pass

    append = store.append

    def failing(df, table):
        if table is tables.LLM_RESULTS:
            waves.append(1)
            if len(waves) == 3:
                raise Broken
        append(df, table)

    store.append = failing
    try:
        reads.work(store, client, 2, wave_rows=3)
    except Broken:
        pass
    assert 0 < store.read(tables.LLM_RESULTS).count() < 12
    store.append = append
    reads.work(store, client, 2, wave_rows=3)
    assert store.read(tables.LLM_RESULTS).count() == 12
    assert store.read(tables.LLM_BATCHES).where("status = 'complete' AND completed_rows + failed_rows = 12").count() == 1


def test_a_request_belongs_to_the_first_claim_until_it_expires(spark, store):
    import datetime as dt

    enqueue(store, 1, [f"p{i}" for i in range(6)])
    noon = dt.datetime(2024, 1, 1, 12)
    after = lambda seconds: noon + dt.timedelta(seconds=seconds)
    first = {r.row_id for r in reads.claim(store, "a", 4, 60, noon).collect()}
    second = {r.row_id for r in reads.claim(store, "b", 4, 60, after(1)).collect()}
    assert len(first) == 4 and len(second) == 2 and not first & second
    assert reads.claim(store, "c", 4, 60, after(2)).collect() == []
    # What a worker holds it keeps, and more when it asks again.
    assert {r.row_id for r in reads.claim(store, "a", 4, 60, after(59)).collect()} == first
    # "a" is never heard of again; "b" answers.
    assert reads.work_claimed(store, "b", client, 0, 60, after(3)) == 2
    assert reads.work_claimed(store, "c", client, 10, 60, after(61)) == 4
    assert reads.work_claimed(store, "c", client, 10, 60, after(62)) == 0
    got = [r.row_id for r in store.read(tables.LLM_RESULTS).collect()]
    assert sorted(got) == sorted(first | second) and len(got) == 6
    assert batch_queue.pending_batches(store.read(tables.LLM_BATCHES)).count() == 0


def test_of_two_claims_at_a_time_one_holds(spark):
    rows = [("b", "r", w, at, at + 60) for w, at in (("x", 10), ("y", 10), ("z", 5))] + [("b", "s", "y", 10, 70)]
    claims = spark.createDataFrame(rows, "batch_id string, row_id string, worker string, c int, e int").select(
        "batch_id", "row_id", "worker", F.timestamp_seconds("c").alias("claimed_at"), F.timestamp_seconds("e").alias("expires_at")
    )
    held = lambda t: sorted((r.row_id, r.worker) for r in batch_queue.live_claims(claims, F.timestamp_seconds(F.lit(t))).collect())
    assert held(20) == [("r", "z"), ("s", "y")] and held(66) == [("r", "x"), ("s", "y")] and held(70) == [] and held(4) == []


def test_streams_of_workers_share_the_work(spark, store, tmp_path):
    enqueue(store, 1, [f"p{i}" for i in range(7)])
    running = [reads.work_stream(store, w, client, str(tmp_path / w), rows=2, every=None) for w in ("a", "b")]
    for query in running:
        query.awaitTermination()
    got = {r.row_id for r in store.read(tables.LLM_RESULTS).collect()}
    assert len(got) == 7 and batch_queue.pending_batches(store.read(tables.LLM_BATCHES)).count() == 0


def test_inputs_are_read_once_for_all_waves(store, monkeypatch):
    enqueue(store, 1, [f"p{i}" for i in range(30)])
    scans = []
    read = store.read
    monkeypatch.setattr(store, "read", lambda table: (scans.append(table.name), read(table))[1])
    waves = []
    append = store.append
    monkeypatch.setattr(store, "append", lambda df, table: (waves.append(table.name), append(df, table))[1])
    reads.work(store, client, 2, wave_rows=5)
    assert waves.count("llm_results") >= 6
    # Once to list the work, once to count what is finished.
    assert scans.count("llm_inputs") == 2 and scans.count("llm_results") == 2


def test_waves_are_ranges_of_shares():
    assert reads._waves({0: 2, 1: 2, 5: 3, 6: 9, 7: 1}, 4) == [(0, 1), (5, 5), (6, 6), (7, 7)]
    assert reads._waves({}, 4) == []
