import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanloom.operators import filters, traces
from spanloom.sources import tables

SECOND = 1_000_000_000
JAN1 = 1_704_067_200 * SECOND


def test_bounds_are_whole_seconds_of_starts_and_merge(make_raw):
    one = make_raw({"trace": "t", "start": 5 * SECOND + 7, "duration": 90 * SECOND}, {"trace": "", "start": 1})
    two = make_raw({"trace": "t", "start": 9 * SECOND + 999}, {"trace": "u", "start": 3})
    partials = traces.trace_bounds(one).unionByName(traces.trace_bounds(two))
    got = {tuple(r) for r in traces.merge_trace_bounds(partials).collect()}
    assert got == {("t", 5 * SECOND, 9 * SECOND), ("u", 0, 0)}


def test_fetching_a_trace_prunes_days(store, make_raw):
    day = 86_400 * SECOND
    raw = make_raw(
        *({"trace": "t", "start": JAN1 + day + i * SECOND + 3, "id": f"{i}"} for i in range(3)),
        {"trace": "u", "start": JAN1}, {"trace": "u", "start": JAN1 + 5 * day},
    )
    store.append(raw, tables.RAW_SPANS)
    store.append(traces.trace_bounds(raw), tables.TRACE_BOUNDS)
    found = traces.fetch_trace(store.read(tables.RAW_SPANS), store.read(tables.TRACE_BOUNDS), "t")
    assert sorted(r.span_id for r in found.collect()) == ["0", "1", "2"]
    scan = [
        l for l in found._jdf.queryExecution().executedPlan().toString().splitlines()
        if "FileScan" in l and "span_id" in l
    ][0]
    partition_filters = scan[scan.index("PartitionFilters"):]
    assert "date" in partition_filters and "ubquery" in partition_filters
    assert traces.fetch_trace(store.read(tables.RAW_SPANS), store.read(tables.TRACE_BOUNDS), "no").count() == 0


@pytest.mark.parametrize("few", (10_000, 1))
def test_fetching_many_traces_does_not_broadcast_the_spans(store, make_raw, monkeypatch, few):
    monkeypatch.setattr(traces, "FEW_TRACES", few)
    day = 86_400 * SECOND
    raw = make_raw(
        *({"trace": t, "start": JAN1 + i * day, "id": f"{t}{i}"} for t in "tuv" for i in range(3)),
        {"trace": "late", "start": JAN1 + 9 * day},
    )
    store.append(raw, tables.RAW_SPANS)
    store.append(traces.trace_bounds(raw), tables.TRACE_BOUNDS)
    wanted = store.read(tables.RAW_SPANS).where("trace_id IN ('t', 'v')").select("trace_id")
    stored = store.read(tables.RAW_SPANS)
    found = traces.fetch_traces(stored, store.read(tables.TRACE_BOUNDS), wanted).select("trace_id", "span_id")
    assert sorted(r.span_id for r in found.collect()) == ["t0", "t1", "t2", "v0", "v1", "v2"]
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [l for l in plan if "HashJoin" in l or "MergeJoin" in l]
    assert joins and not any("BuildLeft" in l for l in joins)
    assert all(("SortMergeJoin" in l) == (few == 1) for l in joins)


def test_series_fills_gaps(make_raw):
    raw = make_raw({"start": 3 * SECOND}, {"start": 4 * SECOND}, {"start": 31 * SECOND})
    got = {r.bucket_ns // SECOND: r.n for r in traces.trace_time_series(raw, 10, "timestamp_ns").collect()}
    assert got == {0: 2, 10: 0, 20: 0, 30: 1}
    assert traces.trace_time_series(raw.where("false"), 10, "timestamp_ns").count() == 0


def test_series_over_decades_is_not_one_array(make_raw):
    raw = make_raw({"start": 0}, {"start": 1_704_067_200 * SECOND})
    series = traces.trace_time_series(raw, 60, "timestamp_ns")
    assert series.count() == 1_704_067_200 // 60 + 1
    assert series.where("n > 0").count() == 2
    bounded = traces.trace_time_series(raw, 60, "timestamp_ns", 60 * SECOND, 180 * SECOND)
    assert sorted((r.bucket_ns // SECOND, r.n) for r in bounded.collect()) == [(60, 0), (120, 0), (180, 0)]


def test_samples_keep_whole_traces_and_are_repeatable(spark):
    df = spark.range(3000).select((F.col("id") % 600).cast("string").alias("trace_id"), "id")
    sampled = filters.sample_traces(df, 0.3)
    per_trace = {r.trace_id: r["count"] for r in sampled.groupBy("trace_id").count().collect()}
    assert set(per_trace.values()) == {5}
    assert 120 < len(per_trace) < 240
    assert {r.trace_id for r in filters.sample_traces(df.repartition(7), 0.3).collect()} == set(per_trace)
    assert filters.sample_traces(df, 0).count() == 0 and filters.sample_traces(df, 1).count() == 3000


def test_time_range_states_the_days(store, make_raw):
    raw = make_raw(*({"start": JAN1 + h * 3600 * SECOND} for h in range(0, 72, 6)))
    store.append(raw, tables.RAW_SPANS)
    first, last = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3)
    found = filters.started_between(store.read(tables.RAW_SPANS), first, last, "timestamp_ns")
    assert found.count() == 6
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text and "GreaterThanOrEqual(timestamp_ns" in text


def test_attribute_filters(make_raw):
    raw = make_raw({"id": "a", "attrs": {"k": 5}}, {"id": "b", "attrs": {"k": "x"}}, {"id": "c"})
    assert {r.span_id for r in filters.with_attribute(raw, "k").collect()} == {"a", "b"}
    assert [r.span_id for r in filters.with_attribute(raw, "k", "5").collect()] == ["a"]
