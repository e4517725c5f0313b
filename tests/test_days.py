"""The ledger of blocks, compacted days, and what lies beside them."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.operators import filters, latest, reads, retention, traces
from spanloom.operators.normalize import normalize_spans
from spanloom.sources import blocks, days, sinks, tables
from spanloom.sources import sample_traces as samples
from spanloom.streaming import ingest

DAY_NS = 86_400_000_000_000
JAN1_NS = 1_704_067_200_000_000_000
FAR = dt.date(2100, 1, 1)
SPANS = tables.SPANS_NORMALIZED


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def messages(store):
    return sorted((r.span_id, r.status_message) for r in reads.spans(store).collect())


@pytest.fixture
def spans(make_raw):
    """``spans(text, *ids)``: one span per id, on the id-th day."""

    def build(text, *ids, **more):
        rows = make_raw(*({"id": f"s{i}", "trace": f"t{i}", "start": JAN1_NS + i * DAY_NS, **more} for i in ids))
        return rows.withColumn("status_message", F.lit(text))

    return build


def test_a_stored_block_is_not_written_again(store, spans):
    first = ingest.write_block(store, spans("a", 1), 0, "here")
    assert ingest.write_block(store, spans("b", 1), 0, "here") is None
    other = ingest.write_block(store, spans("c", 2), 0, "there")
    assert other > first and messages(store) == [("s1", "a"), ("s2", "c")]
    assert store.read(tables.RAW_SPANS).count() == 2
    assert sorted(map(tuple, blocks.counts(store).collect())) == [(first, "here", 0, 1, 0), (other, "there", 0, 1, 0)]


def test_later_deliveries_win_over_checkpoints(store, spans):
    ingest.write_block(store, spans("old", 1, 2), 41, "first checkpoint")
    ingest.write_block(store, spans("new", 1), 0, "second checkpoint")
    assert messages(store) == [("s1", "new"), ("s2", "old")]


def test_half_written_blocks_are_hidden_and_written_anew(store, spans, monkeypatch):
    ingest.write_block(store, spans("kept", 1), 0, "x")

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(sinks, "write_spans", fails)
        with pytest.raises(RuntimeError, match="lost"):
            ingest.write_block(store, spans("half", 1, 2), 1, "x")
    assert store.read(tables.RAW_SPANS).count() == 3
    assert blocks.visible(store, tables.RAW_SPANS).count() == 1
    assert traces.merge_trace_bounds(blocks.visible(store, tables.TRACE_BOUNDS)).count() == 1
    assert reads.trace(store, "t2").count() == 0 and messages(store) == [("s1", "kept")]
    number = ingest.write_block(store, spans("whole", 1, 2), 1, "x")
    assert messages(store) == [("s1", "whole"), ("s2", "whole")]
    assert blocks.visible(store, tables.RAW_SPANS).count() == 3
    seen = blocks.view(store)
    assert seen.last == number and len(seen.hidden) == 1 and blocks.abandoned(store) == list(seen.hidden)
    # Compaction removes what failed blocks left, and only that.
    reads.compact(store, FAR)
    assert messages(store) == [("s1", "whole"), ("s2", "whole")]


def test_blocks_in_progress_are_hidden_also_from_compaction(store, spans):
    ingest.write_block(store, spans("a", 1), 0, "x")
    running = blocks.begin(store, "y", 0)
    assert running is not None
    sinks.write_spans(store, normalize_spans(spans("running", 1, 2).withColumn("_ingest_id", F.lit(running))))
    assert messages(store) == [("s1", "a")]
    reads.compact(store, FAR)
    assert messages(store) == [("s1", "a")]
    blocks.end(store, running, "y", 0, 2, 0)
    assert messages(store) == [("s1", "running"), ("s2", "running")]


def test_numbers_are_given_once(store):
    assert [blocks._claim(store, 1) for _ in range(3)] == [1, 2, 3]
    assert blocks._claim(store, 2) == 4
    assert blocks.begin(store, "x", 0) == 5


def test_folding_keeps_the_ledger(store, spans):
    ingest.write_block(store, spans("a", 1), 0, "x")
    blocks.begin(store, "y", 0)
    before = blocks.view(store)
    tomorrow = dt.datetime.now(dt.timezone.utc).date() + dt.timedelta(days=1)
    assert len(blocks.fold(store, tomorrow)) >= 1
    assert len(store.read(tables.INGEST_BLOCKS).inputFiles()) == len(store.partitions(tables.INGEST_BLOCKS))
    assert blocks.view(store) == before and ingest.write_block(store, spans("b", 1), 0, "x") is None


def test_compacted_days_need_no_shuffle(store, spans):
    ingest.write_block(store, spans("a", 1, 2, 3), 0)
    ingest.write_block(store, spans("b", 2, 3), 1)
    assert "Exchange" in plan(reads.spans(store))
    done = reads.compact(store, dt.date(2024, 1, 4))
    assert sorted(done["spans_normalized"]) == ["2024-01-02", "2024-01-03"]
    rows = reads.spans(store)
    closed = rows.where("date < DATE'2024-01-04'")
    assert messages(store) == [("s1", "a"), ("s2", "b"), ("s3", "b")]
    reads.compact(store, FAR)
    assert messages(store) == [("s1", "a"), ("s2", "b"), ("s3", "b")]
    state = days.days(store, SPANS)
    assert len(state.clean) == 3 and not state.touched
    clean = days.versions(store, SPANS, state.clean)
    assert "Exchange" not in plan(clean) and clean.count() == 3 and closed.count() == 2
    # Nothing open is left, so the other branch of the union has no file to read.
    assert days.open_files(store, SPANS, list(state.clean)) == []
    assert reads.compact(store, FAR)["spans_normalized"] == {}


def test_late_rows_touch_a_compacted_day(store, spans):
    ingest.write_block(store, spans("a", 1, 2), 0)
    reads.compact(store, FAR)
    ingest.write_block(store, spans("late", 1, 1), 1)
    state = days.days(store, SPANS)
    assert list(state.touched) == ["2024-01-02"] and list(state.clean) == ["2024-01-03"]
    assert messages(store) == [("s1", "late"), ("s2", "a")]
    reads.compact(store, FAR)
    assert messages(store) == [("s1", "late"), ("s2", "a")]
    # Two versions of that day; only the newer one is read.
    assert [d for d, _ in days.all_versions(store, SPANS)] == ["2024-01-02", "2024-01-02", "2024-01-03"]


def test_rows_without_a_block_are_never_lost(store, spans):
    ingest.write_block(store, spans("a", 1), 0)
    reads.compact(store, FAR)
    sinks.write_spans(store, normalize_spans(spans("b", 2)))
    sinks.write_spans(store, normalize_spans(spans("c", 1).withColumn("span_id", F.lit("other"))))
    expected = [("other", "c"), ("s1", "a"), ("s2", "b")]
    assert messages(store) == expected
    for _ in range(2):
        reads.compact(store, FAR)
        assert messages(store) == expected


def test_unswept_files_do_no_harm(store, spans):
    ingest.write_block(store, spans("a", 1, 2), 0)
    days.compact(store, SPANS, latest.dedup_spans, FAR, sweep=False)
    assert len(days.days(store, SPANS).touched) == 2
    assert messages(store) == [("s1", "a"), ("s2", "a")]
    days.compact(store, SPANS, latest.dedup_spans, FAR)
    assert len(days.days(store, SPANS).clean) == 2 and messages(store) == [("s1", "a"), ("s2", "a")]


def test_a_failed_compaction_changes_nothing(store, spans, monkeypatch):
    ingest.write_block(store, spans("a", 1), 0)

    def fails(_):
        raise RuntimeError("no index")

    with monkeypatch.context() as patched:
        patched.setattr(days, "key_fields", fails)
        with pytest.raises(RuntimeError, match="no index"):
            reads.compact(store, FAR)
    assert days.all_versions(store, SPANS) == [] and messages(store) == [("s1", "a")]
    reads.compact(store, FAR)
    assert messages(store) == [("s1", "a")]


def test_compacted_days_expire(store, spans):
    ingest.write_block(store, spans("a", 0, 1, 2, 3), 0)
    reads.compact(store, dt.date(2024, 1, 4))
    as_of = dt.datetime(2024, 2, 2, 12)
    assert retention.apply_retention(store, SPANS, as_of) == ["2024-01-01", "2024-01-02"]
    assert messages(store) == [("s2", "a"), ("s3", "a")]
    assert [d for d, _ in days.all_versions(store, SPANS)] == ["2024-01-03"]


def test_traces_are_sampled_by_ranges_of_their_hash(store, make_raw, monkeypatch):
    monkeypatch.setattr(days, "ROWS_PER_FILE", 50)
    raw = make_raw(*({"id": f"s{i}", "trace": f"t{i}", "start": JAN1_NS + i} for i in range(400)))
    ingest.write_block(store, raw, 0)
    expected = sorted(r.span_id for r in filters.sample_traces(reads.spans(store), 0.25).collect())
    reads.compact(store, FAR)
    sample = reads.sampled_spans(store, 0.25)
    assert sorted(r.span_id for r in sample.collect()) == expected and 60 < len(expected) < 140
    assert "LessThan(_trace_hash" in plan(sample)
    folder = store.spark.table(f"`{store.database}`.`{days.days_name(SPANS)}`").inputFiles()
    ranges = []
    for file in folder:
        (low, high), = duckdb.sql(f"SELECT min(_trace_hash), max(_trace_hash) FROM '{file.removeprefix('file:')}'").fetchall()
        ranges.append((low, high))
    ranges.sort()
    # Files hold ranges that do not overlap, so a fraction opens that many of them only.
    assert len(ranges) >= 7 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert sum(low < filters.draw_limit(0.25) for low, _ in ranges) <= len(ranges) / 4 + 1


def test_a_search_for_a_key_reads_files_that_may_hold_it(store, make_raw, monkeypatch):
    monkeypatch.setattr(days, "ROWS_PER_FILE", 20)
    attrs = lambda i: {f"key{i}": f"v{i}", "all": "x"} if i % 40 == 7 else {"all": "x"}
    raw = make_raw(*({"id": f"s{i}", "trace": f"t{i}", "start": JAN1_NS + i, "attrs": attrs(i)} for i in range(200)))
    ingest.write_block(store, raw, 0)
    reads.compact(store, FAR)
    chosen = days.days(store, SPANS).clean
    every = len(days.files_with_key(store, SPANS, chosen, "all"))
    assert every >= 8 and len(days.files_with_key(store, SPANS, chosen, "key47")) <= 2
    assert days.files_with_key(store, SPANS, chosen, "nobody has this key") == []
    found = reads.spans_with_attribute(store, "key47")
    assert [(r.span_id, str(r.date)) for r in found.collect()] == [("s47", "2024-01-01")]
    assert len([f for f in found.inputFiles() if "_days" in f]) <= 2
    assert reads.spans_with_attribute(store, "key47", "v47").count() == 1
    assert reads.spans_with_attribute(store, "key47", "other").count() == 0
    assert reads.spans_with_attribute(store, "all").count() == 200
    # A later delivery without the key hides the one that has it.
    ingest.write_block(store, make_raw({"id": "s47", "trace": "t47", "start": JAN1_NS + 47, "attrs": {"all": "y"}}), 1)
    assert reads.spans_with_attribute(store, "key47").count() == 0


def test_key_index_has_no_false_negatives(spark, make_raw):
    raw = make_raw({"attrs": {f"k{i}": 1 for i in range(3000)}, "start": JAN1_NS})
    fields = days.key_fields(raw.withColumn("date", F.lit(dt.date(2024, 1, 1))))
    bits = {r.word: r.bits for r in fields.where("list = 'span_attributes_keys'").collect()}
    spots = spark.range(3000).select(F.array(*days._spots(F.concat(F.lit("k"), F.col("id").cast("string")))).alias("s")).collect()
    assert all((bits[x >> 6] >> (x & 63)) & 1 for r in spots for x in r.s)


def test_fetching_traces_opens_their_days_only(store, make_raw):
    raw = make_raw(*({"id": f"s{i}", "trace": f"t{i // 2}", "start": JAN1_NS + (i // 2) * DAY_NS + i % 2} for i in range(12)))
    ingest.write_block(store, raw, 0)
    wanted = store.spark.createDataFrame([("t1",), ("t4",), ("none",), ("t1",)], "trace_id string")
    found = reads.traces_of(store, wanted)
    assert "subquery" in plan(found).split("PartitionFilters", 1)[1].lower()
    assert sorted(r.span_id for r in found.collect()) == ["s2", "s3", "s8", "s9"]
    scans = found._jdf.queryExecution().executedPlan()
    text = scans.toString()
    assert "PartitionFilters" in text
    assert reads.traces_of(store, wanted.where("trace_id = 'none'")).collect() == []


def test_a_range_reads_only_its_days(store, spans, spark):
    ingest.write_block(store, spans("a", 1, 2, 3, 4), 0, "here")
    reads.compact(store, FAR)
    ingest.write_block(store, spans("b", 2, 4, 5, 6), 1, "here")
    first, last = JAN1_NS + 2 * DAY_NS, JAN1_NS + 5 * DAY_NS
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    found = reads.spans(store, first_ns=first, last_ns=last)
    read = plan(found)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sorted((r.span_id, r.status_message) for r in found.collect()) == [("s2", "b"), ("s3", "a"), ("s4", "b"), ("s5", "b")]
    # Every scan of spans is told the days: of open files and of versions.
    scans = [line for line in read.splitlines() if "FileScan parquet" in line and "parent_span_id" in line]
    assert len(scans) > 1 and all(">= 2024-01-03" in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in scans), scans
    inside = reads.spans(store, first_ns=first + 1, last_ns=last - 1)
    assert sorted(r.span_id for r in inside.collect()) == ["s3", "s4"]
    assert reads.spans(store, first_ns=last, last_ns=first).count() == 0
    assert reads.sampled_spans(store, 1.0, first_ns=last).count() == 2
    assert reads.spans(store, last_ns=JAN1_NS - 1).count() == 0 and reads.spans(store).count() == 6


def test_a_repeat_at_the_edge_of_a_range_is_told_before_the_range_cuts(store, make_raw):
    # The last delivery begins after the range, so the earlier one must not come up instead.
    for block, offset in enumerate((1_000_000_000, 30_000_000_000)):
        ingest.write_block(store, make_raw({"id": "s1", "trace": "t1", "start": JAN1_NS + offset}), block, "here")
    edge = JAN1_NS + 10_000_000_000
    assert reads.spans(store, last_ns=edge).count() == 0
    assert reads.spans(store, first_ns=edge).count() == 1
    assert reads.numbered_turns(store, last_ns=edge).count() == 0


def test_tables_are_dealt_out_by_their_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    many = 2 * cores * samples.ROWS_PER_TASK
    assert samples.spread(spark.range(0, many, 1, 1), "id").rdd.getNumPartitions() == 2 * cores
    assert samples.spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == cores
