import random

from pyspark.sql import functions as F

from spanloom.operators import annotations, conversations

TURNS = (
    "service_name string, conversation_id string, trace_id string, turn_ns bigint,"
    " status_code smallint, workflow string, prompt_tokens bigint, completion_tokens bigint"
)
SECOND = 1_000_000_000


def test_turn_numbers_against_brute_force_with_a_hot_conversation(spark):
    rng = random.Random(3)
    rows = []
    for i in range(2000):
        conversation = "hot" if rng.random() < 0.4 else f"c{rng.randrange(80)}"
        rows.append(("s", conversation, f"{i:04x}", rng.randrange(300) * SECOND // 4, 0, "w", 1, None))
    expected = {}
    for conversation in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == conversation), key=lambda r: (r[3], r[2]))
        expected |= {r[2]: n for n, r in enumerate(own, 1)}
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    for slice_seconds in (1, 60):
        got = conversations.number_turns(df, slice_seconds).collect()
        assert {r.trace_id: r.turn for r in got} == expected and len(got) == len(rows)


def test_rollup(spark):
    rows = [
        ("s", "a", "1", 10, 0, "w", 1, None), ("s", "a", "2", 30, 2, "w", None, None),
        ("s", "b", "3", 5, None, "", 4, 2), ("t", "b", "4", 6, 1, "", 4, 2),
    ]
    got = {
        (r.service_name, r.conversation_id): r
        for r in conversations.conversation_rollup(spark.createDataFrame(rows, TURNS)).collect()
    }
    a = got["s", "a"]
    assert (a.turns, a.first_turn_ns, a.last_turn_ns, a.status, a.workflow) == (2, 10, 30, "ERROR", "w")
    assert (a.prompt_tokens, a.completion_tokens) == (1, None)
    assert got["s", "b"].status == "OK" and got["t", "b"].turns == 1


def test_rollup_is_combined_before_the_shuffle(spark):
    df = conversations.conversation_rollup(spark.createDataFrame([], TURNS))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text[text.index("Exchange"):]


def test_cluster_gate_keeps_the_raw_pick(spark):
    rows = spark.createDataFrame(
        [("a", 0.4), ("b", 0.5), ("c", 0.9)], "predicted_cluster_key string, confidence float"
    )
    got = annotations.gate_cluster_keys(rows, 0.5).collect()
    assert [(r.predicted_cluster_key, r.cluster_key) for r in got] == [
        ("a", "Uncategorized"), ("b", "b"), ("c", "c")
    ]


def test_turns_move_once(spark):
    rows = [("s", f"c{i % 3}" if i % 2 else "hot", f"t{i // 2}", i * 20_000_000_000, i % 2) for i in range(200)]
    turns = spark.createDataFrame(rows, "service_name string, conversation_id string, trace_id string, turn_ns bigint, _ingest_id int")
    turns = turns.withColumn("date", F.lit("d"))
    repeated = turns.unionByName(turns.withColumn("_ingest_id", F.col("_ingest_id") + 5))
    numbered = conversations.number_deliveries(repeated)
    numbered.collect()
    plan = numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    # The turns; their keys once more for counting; the counts by conversation and, small, back by slice.
    assert len(shuffles) <= 4, plan
    key = lambda r: (r.conversation_id, r.turn, r.trace_id)
    assert sorted(map(key, numbered.collect())) == sorted(map(key, conversations.number_turns(turns).collect()))
