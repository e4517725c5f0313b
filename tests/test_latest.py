import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import latest
from spanloom.operators.normalize import normalize_spans

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_limit_by_needs_an_order(spark):
    with pytest.raises(ValueError):
        latest.limit_by(spark.range(1), 1, ["id"], [])


def test_limit_by_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(50), rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, i int").repartition(6)
    got = latest.limit_by(df, 3, ["k"], [F.desc("v"), F.desc("i")])
    expected = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], -r[2]))
        expected += own[:3]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 2 AS k", "id AS v")
    text = plan(latest.limit_by(df, 1, ["k"], [F.desc("v")]))
    before_shuffle = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_latest_scores(spark):
    schema = (
        "monitor_uuid string, service_name string, conversation_id string, eval_type string,"
        " score double, reasoning string, batch_id string, scored_at timestamp"
    )
    rows = [
        ("m1", "s", "c", "tone", 1.0, "", "b", at(0)),
        ("m1", "s", "c", "tone", 2.0, "", "b", at(9)),
        ("m1", "s", "c", "tone", 3.0, "", "b", at(5)),
        ("m2", "s", "c", "tone", 4.0, "", "b", at(0)),
        ("m1", "s", "c", "other", 5.0, "", "b", at(0)),
    ]
    got = latest.latest_eval_scores(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.score for r in got) == [2.0, 4.0, 5.0]


def test_latest_batches_prefers_complete_in_the_same_second(spark):
    schema = (
        "batch_id string, status string, total_rows bigint, completed_rows bigint,"
        " failed_rows bigint, created_at timestamp"
    )
    rows = [
        ("a", "complete", 2, 2, 0, at(1)), ("a", "pending", 2, 0, 0, at(1)),
        ("b", "pending", 1, 0, 0, at(3)), ("b", "complete", 1, 1, 0, at(2)),
    ]
    got = latest.latest_batches(spark.createDataFrame(rows, schema)).collect()
    assert {r.batch_id: r.status for r in got} == {"a": "complete", "b": "pending"}


def test_dedup_spans_keeps_the_last_delivery_whatever_the_order(make_raw):
    spans = [{"id": "s1", "trace": "t", "start": 60, "name": n} for n in ("first", "second")]
    spans.append({"id": "s2", "trace": "t", "start": 60, "name": "other"})
    deliveries = [
        normalize_spans(make_raw(s).withColumn("_ingest_id", F.lit(i))) for i, s in enumerate(spans)
    ]
    for order in ((0, 1, 2), (2, 1, 0)):
        rows = deliveries[order[0]]
        for i in order[1:]:
            rows = rows.unionByName(deliveries[i])
        got = latest.dedup_spans(rows.unionByName(rows)).collect()
        assert {r.span_id: r.span_name for r in got} == {"s1": "second", "s2": "other"}
        assert len(got) == 2


def test_filters_reach_below_the_dedup(store):
    from spanloom.sources import tables

    rows = latest.dedup_spans(store.read(tables.SPANS_NORMALIZED))
    text = plan(rows.where("date = DATE'2024-01-01' AND service_name = 's'").select("span_id"))
    scan = [l for l in text.splitlines() if "FileScan" in l][0]
    assert "PartitionFilters: [isnotnull(date" in scan and "EqualTo(service_name,s)" in scan
    assert "span_attributes" not in scan
