import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.operators import reads, retention
from spanloom.operators.normalize import normalize_spans
from spanloom.sources import tables

B1 = "00000000-0000-4000-8000-000000000001"
B2 = "00000000-0000-4000-8000-000000000002"
DAY_NS = 86_400_000_000_000
JAN1_NS = 1_704_067_200_000_000_000


def test_creating_tables_is_repeatable(store):
    store.ensure_tables()
    names = {r.tableName for r in store.spark.sql(f"SHOW TABLES IN `{store.database}`").collect()}
    assert set(tables.TABLES) <= names


def test_queue_defaults(store):
    rows = store.spark.createDataFrame(
        [(B1, B2, "m", "p", None)], "batch_id string, row_id string, model_id string, prompt string, params string"
    )
    store.append(rows, tables.LLM_INPUTS)
    row = store.read(tables.LLM_INPUTS).first()
    assert (row.params, row.tool_config) == ("{}", "") and row.created_at is not None


@pytest.mark.parametrize("status, batch", [("done", B1), (None, B1), ("pending", "no-uuid")])
def test_bad_values_are_rejected(store, status, batch):
    rows = store.spark.createDataFrame([(batch, status)], "batch_id string, status string")
    with pytest.raises(Exception, match="not allowed|not a UUID"):
        store.append(rows, tables.LLM_BATCHES)
    assert store.read(tables.LLM_BATCHES).count() == 0


def test_columns_are_matched_by_name(store):
    rows = store.spark.createDataFrame(
        [("ok", B2, B1, "complete")], "response string, row_id string, batch_id string, status string"
    )
    store.append(rows, tables.LLM_RESULTS)
    row = store.read(tables.LLM_RESULTS).first()
    assert (row.batch_id, row.row_id, row.response, row.error) == (B1, B2, "ok", "")


def test_spans_are_partitioned_by_day_and_read_back(store, make_raw):
    raw = make_raw(
        {"start": JAN1_NS + DAY_NS - 1, "attrs": {"gen_ai.prompt.0.role": "user", "n": 1.5}},
        {"start": JAN1_NS + DAY_NS},
    )
    store.append(normalize_spans(raw), tables.SPANS_NORMALIZED)
    assert store.partitions(tables.SPANS_NORMALIZED) == ["2024-01-01", "2024-01-02"]
    reads.register_spans_view(store, "spans_for_test")
    row = store.spark.sql("SELECT * FROM spans_for_test WHERE date = DATE'2024-01-01'").first()
    assert row.prompts[0].is_start and row.prompts[0].is_end
    assert float(row.span_attributes["n"].toPython()) == 1.5


def test_whole_days_expire(store, make_raw):
    raw = make_raw(*({"start": JAN1_NS + d * DAY_NS + 5} for d in range(4)))
    store.append(raw, tables.RAW_SPANS)
    store.append(normalize_spans(raw), tables.SPANS_NORMALIZED)
    as_of = dt.datetime(2024, 2, 2, 12)
    # Normalized spans age from their instant: 3 January is only partly expired
    # at noon and stays whole. Raw spans age from their day.
    assert retention.apply_retention(store, tables.SPANS_NORMALIZED, as_of) == ["2024-01-01", "2024-01-02"]
    assert store.partitions(tables.SPANS_NORMALIZED) == ["2024-01-03", "2024-01-04"]
    retention.apply_retention(store, tables.RAW_SPANS, as_of)
    assert store.partitions(tables.RAW_SPANS) == ["2024-01-04"]
    assert retention.apply_retention(store, tables.RAW_SPANS, as_of) == []


def _scores(spark, *times):
    rows = [(B1, "s", "c", "t", float(i), "", B2, t) for i, t in enumerate(times)]
    return spark.createDataFrame(
        rows,
        "monitor_uuid string, service_name string, conversation_id string, eval_type string,"
        " score double, reasoning string, batch_id string, scored_at timestamp",
    )


def test_rows_expire_one_by_one(store):
    times = [dt.datetime(2023, 12, 5), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3, 13), dt.datetime(2024, 2, 1)]
    store.append(_scores(store.spark, *times), tables.EVAL_SCORES)
    as_of = dt.datetime(2024, 2, 2, 12)
    dropped = retention.apply_retention_everywhere(store, as_of)
    assert dropped["conversation_eval_scores"] == ["2023-12-05", "2024-01-02"]
    assert sorted(r.scored_at for r in store.read(tables.EVAL_SCORES).collect()) == times[2:]


def test_the_days_kept_do_not_depend_on_the_time_zone():
    east = dt.datetime(2024, 2, 10, 3, tzinfo=dt.timezone(dt.timedelta(hours=5)))
    assert retention.first_kept_day(30, east) == retention.first_kept_day(30, east.astimezone(dt.timezone.utc))
    assert retention.first_kept_day(30, east) == dt.date(2024, 1, 10)


def test_only_the_cut_off_day_is_rewritten(store, monkeypatch):
    """On the 31st too, rows of the current month stay where they are."""
    times = [dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 31, 11)]
    store.append(_scores(store.spark, *times), tables.EVAL_SCORES)
    rewritten = []
    replace = store.replace_partition
    monkeypatch.setattr(store, "replace_partition", lambda df, t, day: (rewritten.append(day), replace(df, t, day)))
    retention.apply_retention(store, tables.EVAL_SCORES, dt.datetime(2024, 1, 31, 12))
    assert rewritten == ["2024-01-01"]
    assert sorted(r.scored_at for r in store.read(tables.EVAL_SCORES).collect()) == times[1:]


def test_ids_compare_by_value_and_counts_are_checked(store):
    rows = store.spark.createDataFrame([(B1.upper(), 1)], "batch_id string, total_rows bigint")
    rows = rows.withColumn("status", F.lit("pending"))
    store.append(rows, tables.LLM_BATCHES)
    assert store.read(tables.LLM_BATCHES).first().batch_id == B1.lower()
    with pytest.raises(Exception, match="out of range"):
        store.append(rows.withColumn("total_rows", F.lit(2**32)), tables.LLM_BATCHES)


def test_queue_tables_ignore_the_setting(store):
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 20)
    rows = store.spark.createDataFrame([(B1, B1, "m", "p", t) for t in (old, new)],
                                       "batch_id string, row_id string, model_id string, prompt string, created_at timestamp")
    store.append(rows, tables.LLM_INPUTS)
    retention.apply_retention(store, tables.LLM_INPUTS, dt.datetime(2024, 2, 5), days=7)
    assert [r.created_at for r in store.read(tables.LLM_INPUTS).collect()] == [new]
    assert retention.ttl_days(tables.LLM_INPUTS, 7) == 30
    assert retention.ttl_days(tables.EVAL_SCORES, 7) == 7


def test_boundary_day_without_any_row_left_is_dropped(store):
    store.append(_scores(store.spark, dt.datetime(2024, 1, 11)), tables.EVAL_SCORES)
    retention.apply_retention(store, tables.EVAL_SCORES, dt.datetime(2024, 2, 10))
    assert store.partitions(tables.EVAL_SCORES) == []
    assert store.read(tables.EVAL_SCORES).count() == 0


def test_writes_are_sorted_and_balanced(store, make_raw):
    laid_out = store.laid_out(make_raw({}), tables.RAW_SPANS)
    text = laid_out._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in text
    assert text.count("Sort ") == 1


def test_ids_have_bloom_filters_and_files_stay_small(store, make_raw):
    store.append(normalize_spans(make_raw(*({} for _ in range(300)))), tables.SPANS_NORMALIZED)
    file = store.read(tables.SPANS_NORMALIZED).inputFiles()[0].removeprefix("file:")
    # Repetitive ids are dictionary-coded and need no filter.
    filtered = duckdb.sql(
        f"SELECT path_in_schema FROM parquet_metadata('{file}') WHERE bloom_filter_offset IS NOT NULL"
    ).fetchall()
    assert ("span_id",) in filtered
    assert os.path.getsize(file) < 200_000


def test_unexpired_is_strict(spark):
    as_of = dt.datetime(2024, 2, 1)
    cut = JAN1_NS + DAY_NS
    df = spark.createDataFrame([(cut,), (cut + 1,)], "t bigint")
    assert [r.t for r in retention.unexpired(df, F.col("t"), 30, as_of).collect()] == [cut + 1]
