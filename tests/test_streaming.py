"""A stream of many files gives what one batch gives."""

import json

from pyspark.sql import functions as F

from spanloom.operators import latest, reads, traces
from spanloom.sources import blocks, otlp, tables
from spanloom.sources.tables import Store
from spanloom.streaming import ingest


def _documents(n):
    for i in range(n):
        attributes = [
            {"key": "session.id", "value": {"stringValue": f"c{i % 3}"}},
            {"key": "gen_ai.prompt.0.role", "value": {"stringValue": "user"}},
            {"key": "traceloop.entity.input", "value": {"stringValue": json.dumps(
                {"inputs": {"messages": [{"type": "human", "content": f"q{i}"}]}})}},
        ]
        yield json.dumps({"resourceSpans": [{"resource": {"attributes": [
            {"key": "service.name", "value": {"stringValue": "s"}}]}, "scopeSpans": [{"spans": [
                {"traceId": f"t{i // 2}", "spanId": f"{i}", "parentSpanId": "" if i % 2 == 0 else f"{i - 1}",
                 "name": "n", "startTimeUnixNano": str(1_704_067_200_000_000_000 + i * 700_000_000),
                 "endTimeUnixNano": str(1_704_067_200_500_000_000 + i * 700_000_000),
                 "attributes": attributes}]}]}]})


def _contents(store):
    spans = reads.spans(store).select("trace_id", "span_id", "start_ns", "has_prompts", "conversation_id")
    turns = reads.numbered_turns(store).select("conversation_id", "trace_id", "turn", "user_input")
    bounds = traces.merge_trace_bounds(store.read(tables.TRACE_BOUNDS))
    return [sorted(map(tuple, df.collect())) for df in (spans, turns, bounds)]


def _store(spark, tmp_path, name):
    return Store(spark, f"{name}_{abs(hash(str(tmp_path)))}", str(tmp_path / name)).ensure_tables()


def test_stream_equals_batch(spark, tmp_path):
    lines = list(_documents(12))
    source = tmp_path / "in"
    source.mkdir()
    for i in range(4):
        (source / f"{i}.json").write_text("\n".join(lines[i * 3: i * 3 + 3]))

    streamed = _store(spark, tmp_path, "streamed")
    query = ingest.start_ingest(
        otlp.stream_spans(spark, str(source), max_files_per_trigger=1), streamed,
        str(tmp_path / "checkpoint"), every=None,
    )
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4

    batch = _store(spark, tmp_path, "batch")
    raw = otlp.read_otlp_json(spark, str(source))
    ingest.write_block(batch, raw, 0)
    ingest.write_block(batch, raw, 1)  # delivered again

    assert batch.read(tables.SPANS_NORMALIZED).count() == 24
    contents = _contents(batch)
    assert _contents(streamed) == contents
    spans, turns, bounds = contents
    assert len(spans) == 12 and len(turns) == 6 and len(bounds) == 6

    # A restart takes in only what is new.
    (source / "4.json").write_text("\n".join(_documents(13)).splitlines()[-1])
    ingest.start_ingest(
        otlp.stream_spans(spark, str(source)), streamed, str(tmp_path / "checkpoint"), every=None
    ).awaitTermination()
    assert streamed.read(tables.RAW_SPANS).count() == 13


def test_redeliveries_are_dropped_in_the_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = list(_documents(3))
    (source / "0.json").write_text("\n".join(lines))
    (source / "1.json").write_text("\n".join(lines))
    stream = ingest.dedup_redeliveries(otlp.stream_spans(spark, str(source), 1))
    query = (
        stream.select("span_id").writeStream.format("memory").queryName("deduplicated")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.span_id for r in spark.table("deduplicated").collect()) == ["0", "1", "2"]


def test_spans_that_began_early_are_no_repeats(spark, tmp_path):
    """The second file holds a span that began hours before the first file's, and a repeat."""
    source = tmp_path / "in"
    source.mkdir()
    one, two, three = _documents(3)
    early = three.replace('"startTimeUnixNano": "17', '"startTimeUnixNano": "16').replace('"startTimeUnixNano":"17', '"startTimeUnixNano":"16')
    assert early != three
    (source / "0.json").write_text("\n".join([one, two]))
    (source / "1.json").write_text("\n".join([early, one]))
    stream = ingest.dedup_redeliveries(otlp.stream_spans(spark, str(source), 1), "1 minute")
    query = (
        stream.select("span_id").writeStream.format("memory").queryName("early")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r.span_id for r in spark.table("early").collect()) == ["0", "1", "2"]


def test_turn_derivation_needs_no_shuffle(spark, make_raw):
    from spanloom.operators.normalize import normalize_spans
    from spanloom.operators.turns import to_turns

    text = to_turns(normalize_spans(make_raw({})))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


def test_dedup_keys_survive_a_tie(make_raw):
    from spanloom.operators.normalize import normalize_spans

    rows = normalize_spans(make_raw({"id": "a"}).withColumn("_ingest_id", F.lit(3)))
    assert latest.dedup_spans(rows.unionByName(rows)).count() == 1


def test_rejects_are_stored_beside_the_spans(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    one, two, three = _documents(3)
    undated = two.replace('"startTimeUnixNano": "17', '"startTimeUnixNano": "soon 17')
    (source / "0.json").write_text("\n".join([one, "no document", undated, "", three[:-2]]))
    store = _store(spark, tmp_path, "rejecting")
    for _ in range(2):  # the second time nothing is new
        stream = otlp.stream_spans(spark, str(source), rejects=True)
        ingest.start_ingest(stream, store, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    assert [r.span_id for r in reads.spans(store).collect()] == ["0"]
    found = sorted((r.reason, r.text) for r in reads.rejects(store).collect())
    assert [r for r, _ in found] == ["malformed document", "malformed document", "no start time"]
    assert {"no document", three[:-2]} == {t for r, t in found if r == "malformed document"} and "soon 17" in found[2][1]
    assert [(r.spans, r.rejected) for r in blocks.counts(store).collect()] == [(1, 3)]
    assert store.partitions(tables.RAW_SPANS) == ["2024-01-01"]
    # Without rejects the same spans come.
    plain = otlp.stream_spans(spark, str(source))
    assert set(plain.columns) == set(stream.columns) - set(otlp.REJECT_COLUMNS)


def test_traces_close_once_they_are_silent(spark, tmp_path):
    second = 1_000_000_000
    source = tmp_path / "in"
    source.mkdir()

    def add(name, *rows):
        (source / name).write_text("\n".join(json.dumps({"trace_id": t, "timestamp_ns": s * second + 5}) for t, s in rows))

    def run():
        stream = spark.readStream.schema("trace_id string, timestamp_ns bigint").json(str(source))
        writer = ingest.closed_trace_bounds(stream, "60 seconds", "10 seconds").writeStream.format("parquet")
        writer = writer.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema("trace_id string, first_start_ns bigint, last_start_ns bigint").parquet(str(tmp_path / "out"))
        return sorted((r.trace_id, r.first_start_ns // second, r.last_start_ns // second) for r in rows.collect())

    add("0.json", ("a", 100), ("a", 140), ("b", 150), ("", 100))
    assert run() == []
    add("1.json", ("b", 200), ("c", 215))
    assert run() == [("a", 100, 140)]
    add("2.json", ("c", 900))
    assert run() == [("a", 100, 140), ("b", 150, 200), ("c", 215, 215)]
