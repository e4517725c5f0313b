"""Spans, turns, annotations and requests derived from the driver's tables.

The tables at hand hold no traces, so these projections build them, row by row
and deterministically, in the shapes the engine reads. They add no rows of
their own: their size follows the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import attribute_keys as K
from spanloom.functions import timestamps
from spanloom.functions.attributes import attribute_keys
from spanloom.functions.reuse import built_once
from spanloom.operators.annotations import gate_cluster_keys

BASE_SECONDS = 1_704_067_200
"""2024-01-01T00:00:00Z, the first instant of the ``events`` table."""
MIN_CONFIDENCE = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(ts: Column) -> Column:
    """The table's timestamps carry no time zone; they are read as UTC."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz"))


def uuid_text(number: Column) -> Column:
    return F.format_string("00000000-0000-4000-8000-%012x", number)


def attribute_map(values: dict[str, Column]) -> Column:
    """Attribute map of the given columns; NULL ones are left out."""
    pairs = [part for k, v in values.items() for part in (F.lit(k), v.cast("variant"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _no_attributes() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))


def _event(at: Column, name: str, values: dict[str, Column]) -> Column:
    return F.struct(
        at.alias("timestamp_ns"), F.lit(name).alias("name"), attribute_map(values).alias("attributes")
    )


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- spans from ``events`` -------------------------------------------------


def _semconv_attributes(e: Column, user: Column, kind: Column, k: Column) -> Column:
    operation = F.when(kind.isin("click", "view"), "chat").when(kind == "purchase", "execute_tool")
    return attribute_map(
        {
            K.MODEL_KEYS[0]: _text("model-", user % 3),
            K.OPERATION_KEY: operation,
            K.PROMPT_TOKEN_KEYS[0]: k,
            K.COMPLETION_TOKEN_KEYS[0]: (k + 1).cast("string"),
            K.TOTAL_TOKEN_KEYS[0]: F.when(kind == "error", "abc").otherwise((2 * k + 1).cast("string")),
            K.WORKFLOW_KEYS[0]: _text("wf-", user % 5),
            K.TASK_KEYS[0]: _text("task-", k % 3),
            K.CONVERSATION_KEYS[0]: _text("conv-", user),
            "gen_ai.prompt.10.role": F.lit("user"),
            "gen_ai.prompt.10.content": _text("ask ", k),
            "gen_ai.prompt.0.role": F.lit("system"),
            "gen_ai.prompt.0.content": _text("sys ", kind),
            "gen_ai.prompt.2.role": F.lit("user"),
            "gen_ai.prompt.2.content": k,
            "gen_ai.prompt.3.content": F.lit("no role"),
            "gen_ai.completion.0.role": F.lit("assistant"),
            "gen_ai.completion.0.content": _text("ans ", k),
            "gen_ai.completion.0.tool_calls.0.id": _text("call-", e),
            "gen_ai.completion.0.tool_calls.0.name": F.lit("search"),
            "gen_ai.completion.0.tool_calls.0.arguments": _text('{"q":', k, "}"),
            "gen_ai.completion.0.tool_calls.1.id": F.lit("no name"),
            "gen_ai.completion.0.tool_calls.2.name": F.lit("lookup"),
            "gen_ai.completion.1.role": F.lit(""),
        }
    )


def _openinference_attributes(e: Column, user: Column, kind: Column, k: Column) -> Column:
    call = "llm.output_messages.0.message.tool_calls."
    return attribute_map(
        {
            K.MODEL_KEYS[1]: _text("oi-", user % 2),
            K.PROMPT_TOKEN_KEYS[2]: 2 * k,
            K.COMPLETION_TOKEN_KEYS[2]: (k + 3).cast("string"),
            K.TOTAL_TOKEN_KEYS[2]: 3 * k + 3,
            K.WORKFLOW_KEYS[1]: _text("twf-", user % 3),
            K.TASK_KEYS[1]: _text("node-", k % 4),
            K.CONVERSATION_KEYS[1]: _text("conv-", user),
            "openinference.span.kind": F.when(kind == "purchase", "TOOL").otherwise("LLM"),
            "llm.input_messages.0.message.role": F.lit("user"),
            "llm.input_messages.0.message.content": _text("oi ask ", k),
            "llm.input_messages.1.message.role": F.lit("user"),
            "llm.input_messages.1.message.content": F.lit("oi second"),
            "gen_ai.prompt.1.role": F.when(kind == "view", "tool"),
            "gen_ai.prompt.1.content": F.when(kind == "view", _text("both ", k)),
            "llm.output_messages.0.message.role": F.lit("assistant"),
            "llm.output_messages.0.message.content": _text("oi ans ", k),
            call + "0.tool_call.id": _text("oic-", e),
            call + "0.tool_call.function.name": F.lit("calc"),
            call + "0.tool_call.function.arguments": _text('{"x":', k, "}"),
            call + "1.tool_call.function.name": F.lit("no id"),
        }
    )


def _event_attributes(e: Column, user: Column, kind: Column, k: Column) -> Column:
    return attribute_map(
        {
            K.MODEL_KEYS[0]: F.lit(""),
            K.OPERATION_KEY: F.when(kind != "signup", "chat"),
            K.PROMPT_TOKEN_KEYS[1]: F.lit(0),
            K.COMPLETION_TOKEN_KEYS[1]: k,
            K.TOTAL_TOKEN_KEYS[1]: k,
            "traceloop.span.kind": F.when(kind == "purchase", "tool"),
            K.CONVERSATION_KEYS[0]: F.lit(""),
            K.CONVERSATION_KEYS[1]: _text("conv-", user),
        }
    )


def _native_attributes(e: Column, user: Column, kind: Column, k: Column) -> Column:
    return attribute_map(
        {
            K.MODEL_KEYS[2]: _text("native-", user % 2),
            K.PROMPT_TOKEN_KEYS[3]: k.cast("string"),
            K.COMPLETION_TOKEN_KEYS[3]: k,
            K.CONVERSATION_KEYS[2]: _text("conv-", user),
            K.NATIVE_PROMPT_KEYS[0]: F.when(kind == "view", _text("root ", k)),
            K.NATIVE_PROMPT_KEYS[1]: F.when(kind != "signup", _text("plan ", k)),
            K.NATIVE_COMPLETION_KEYS[0]: F.when(kind == "purchase", _text("out ", k)),
            K.NATIVE_COMPLETION_KEYS[2]: F.when(kind.isin("click", "view"), _text("think ", k)),
            K.NATIVE_COMPLETION_KEYS[4]: F.when(kind == "error", _text("text ", k)),
        }
    )


def _message_events(at: Column, kind: Column, k: Column) -> Column:
    return F.array(
        _event(at, "gen_ai.user.message", {"content": _text("ev ask ", k)}),
        _event(at, "gen_ai.assistant.message", {"content": _text("ev ans ", k)}),
        _event(at, "gen_ai.user.message", {"content": F.lit("ev more")}),
        _event(at, "gen_ai.choice", {"message": _text("ev choice ", kind)}),
    )


def _exception_events(at: Column, k: Column) -> Column:
    return F.array(
        _event(at, "exception", {K.EXCEPTION_TYPE: F.lit("Timeout"), K.EXCEPTION_MESSAGE: _text("m", k)}),
        _event(at, "exception", {K.EXCEPTION_TYPE: F.lit("Other")}),
    )


@built_once
def _attribute_columns() -> list[Column]:
    e, user, kind, k = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("k")
    return [
        F.when(e % 4 == 0, _semconv_attributes(e, user, kind, k))
        .when(e % 4 == 1, _openinference_attributes(e, user, kind, k))
        .when(e % 4 == 2, _event_attributes(e, user, kind, k))
        .otherwise(_native_attributes(e, user, kind, k))
        .alias("span_attributes")
    ]


@built_once
def _span_columns() -> list[Column]:
    e, kind, k, at = F.col("event_id"), F.col("event_type"), F.col("k"), F.col("at")
    no_events = F.array().cast(_message_events_type())
    resource = attribute_map({"service.name": F.col("service_name")})
    return [
        at.alias("timestamp_ns"),
        F.when(e % 250 == 249, "")
        .otherwise(F.format_string("%032x", F.expr("event_id div 5")))
        .alias("trace_id"),
        F.format_string("%016x", e).alias("span_id"),
        F.when(e % 5 == 0, "").otherwise(F.format_string("%016x", e - e % 5)).alias("parent_span_id"),
        F.lit("").alias("trace_state"),
        _text("op ", kind).alias("span_name"),
        F.lit("Internal").alias("span_kind"),
        F.col("service_name"),
        resource.alias("resource_attributes"),
        attribute_keys(resource).alias("resource_attributes_keys"),
        F.lit("").alias("scope_name"),
        F.lit("").alias("scope_version"),
        F.col("span_attributes"),
        attribute_keys(F.col("span_attributes")).alias("span_attributes_keys"),
        F.round(F.col("value") * 1e6).cast("bigint").alias("duration_ns"),
        F.when(kind.isin("click", "purchase"), "Ok")
        .when(kind == "view", "Unset")
        .when(kind == "error", "Error")
        .otherwise("ok")
        .alias("status_code"),
        F.when(kind == "error", _text("failed ", k)).otherwise("").alias("status_message"),
        F.concat(
            F.when(e % 4 == 2, _message_events(at, kind, k)).otherwise(no_events),
            F.when(kind == "error", _exception_events(at, k)).otherwise(no_events),
        ).alias("events"),
        F.array().cast(_links_type()).alias("links"),
    ]


EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def spans_from_events(events: DataFrame) -> DataFrame:
    """Raw spans: five per trace, the first one its root, dialects in turn."""
    e = F.col("event_id")
    return (
        events.select(
            "event_id", "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            (epoch_micros(F.col("ts")) * 1000 + e % 1000).alias("at"),
            _text("svc-", F.col("user_id") % 4).alias("service_name"),
        )
        .select("*", *_attribute_columns())
        .select(*_span_columns())
    )


def _message_events_type() -> str:
    return "array<struct<timestamp_ns: bigint, name: string, attributes: map<string, variant>>>"


def _links_type() -> str:
    return (
        "array<struct<trace_id: string, span_id: string, trace_state: string,"
        " attributes: map<string, variant>>>"
    )


ROWS_PER_TASK = 25_000
"""Rows that a task of the normalization gets; some seconds of work."""


def tasks_for(df: DataFrame) -> int:
    """Tasks for the rows, one per core at least. The rows of a Parquet table are counted in its footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table that has fewer splits than its rows need out to so many tasks.

    Normalization costs far more per row than moving the narrow source row, and a
    split of compressed events holds millions of them.
    """
    many = tasks_for(df)
    return df.repartition(many, key) if df.rdd.getNumPartitions() < many else df


def raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(*EVENT_COLUMNS)
    return spans_from_events(spread(events, "event_id"))


# --- OTLP documents from ``events`` ----------------------------------------


def otlp_documents(events: DataFrame) -> DataFrame:
    """One OTLP/JSON document per event (column ``value``), one span in each."""
    e, kind = F.col("event_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k")
    at = epoch_micros(F.col("ts")) * 1000 + e % 1000
    end = at + F.round(F.col("value") * 1e6).cast("bigint")

    def tag(name: str, value: Column) -> Column:
        return F.to_json(F.struct(value.alias(name)))

    def attribute(key: str, value_json: Column) -> Column:
        return F.concat(F.lit(f'{{"key":"{key}","value":'), value_json, F.lit("}"))

    service = attribute("service.name", tag("stringValue", _text("svc-", F.col("user_id") % 4)))
    tags = F.concat(
        F.lit('{"arrayValue":{"values":['), tag("stringValue", kind), F.lit(","), tag("intValue", k),
        F.lit("]}}"),
    )
    nested = F.concat(
        F.lit('{"kvlistValue":{"values":['), attribute("id", tag("stringValue", _text("s-", e))),
        F.lit("]}}"),
    )
    attributes = F.concat_ws(
        ",",
        attribute("gen_ai.usage.prompt_tokens", tag("intValue", k)),
        attribute("gen_ai.request.model", tag("stringValue", F.lit("replaced"))),
        attribute("gen_ai.request.model", tag("stringValue", _text("model-", F.col("user_id") % 3))),
        attribute("ratio", tag("doubleValue", F.col("value"))),
        attribute("flag", tag("boolValue", e % 2 == 0)),
        attribute("tags", tags),
        attribute("session", nested),
    )
    status = F.when(kind == "error", '{"code":2,"message":"failed"}').when(
        kind == "click", '{"code":"STATUS_CODE_OK"}'
    ).otherwise("{}")
    span = F.concat(
        F.lit('{"traceId":"'), F.format_string("%032x", F.expr("event_id div 5")),
        F.lit('","spanId":"'), F.format_string("%016x", e),
        F.lit('","name":'), F.to_json(F.array(kind)).substr(F.lit(2), F.length(kind) + 2),
        F.lit(',"kind":2,"startTimeUnixNano":"'), at.cast("string"),
        F.lit('","endTimeUnixNano":"'), end.cast("string"),
        F.lit('","attributes":['), attributes, F.lit('],"status":'), status, F.lit("}"),
    )
    document = F.concat(
        F.lit('{"resourceSpans":[{"resource":{"attributes":['), service,
        F.lit(']},"scopeSpans":[{"spans":['), span, F.lit("]}]}]}"),
    )
    return events.select(document.alias("value"))


# --- root spans with turns from ``conversations`` ---------------------------


def turn_spans(conversations: DataFrame) -> DataFrame:
    """One root span per user row (with the answer that follows it, if any) and
    one without payload per system row."""
    c, turn = F.col("conv_id"), F.col("turn")
    answers = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (turn - 1).alias("turn"), F.col("text").alias("answer")
    )
    asked = conversations.where(F.col("role").isin("user", "system")).join(
        answers, ["conv_id", "turn"], "left"
    )
    shape = c % 4
    is_user = F.col("role") == "user"

    def message(kind: str, content: Column, wrapped: bool) -> Column:
        flat = F.struct(F.lit(kind).alias("type"), content.alias("content"))
        return F.to_json(F.struct(flat.alias("kwargs")) if wrapped else flat)

    def block(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def payload(side: str, *messages: Column) -> Column:
        return F.concat(
            F.lit(f'{{"{side}":{{"messages":['), F.concat_ws(",", *messages), F.lit("]}}")
        )

    question = (
        F.when(shape == 1, message("human", F.col("text"), True))
        .when(shape == 3, message("human", F.array(block("text", F.col("text"))), False))
        .otherwise(message("human", F.col("text"), False))
    )
    answer = (
        F.when(
            shape == 1,
            message(
                "ai",
                F.array(
                    block("text", F.col("answer")),
                    block("tool_use", F.lit("hidden")),
                    block("text", F.lit("done")),
                ),
                True,
            ),
        )
        .when(shape == 2, message("ai", F.col("answer"), False))
        .otherwise(message("ai", F.col("answer"), True))
    )
    entity_input = payload(
        "inputs", message("human", F.lit("earlier"), False), message("ai", F.lit("reply"), True),
        question, message("system", F.lit("rules"), False),
    )
    entity_output = payload("outputs", message("ai", F.lit("draft"), True), answer)
    attributes = attribute_map(
        {
            K.ENTITY_INPUT: F.when(is_user & (c % 7 != 6), entity_input),
            K.ENTITY_OUTPUT: F.when(is_user & F.col("answer").isNotNull(), entity_output),
            K.CONVERSATION_KEYS[1]: F.when(c % 11 != 10, _text("c", c)),
            K.WORKFLOW_KEYS[1]: _text("flow-", c % 3),
            K.PROMPT_TOKEN_KEYS[0]: F.length("text").cast("bigint"),
            K.COMPLETION_TOKEN_KEYS[0]: F.length("answer").cast("bigint"),
        }
    )
    rows = asked.select("*", attributes.alias("span_attributes"))
    start = (F.lit(BASE_SECONDS) + c * 60 + turn) * timestamps.NS_PER_SECOND
    return rows.select(
        start.alias("timestamp_ns"),
        F.format_string("%024x%08x", c, turn).alias("trace_id"),
        F.format_string("%016x", c * 1000 + turn).alias("span_id"),
        F.lit("").alias("parent_span_id"),
        F.lit("").alias("trace_state"),
        F.lit("chat.workflow").alias("span_name"),
        F.lit("Server").alias("span_kind"),
        _text("chat-", c % 3).alias("service_name"),
        _no_attributes().alias("resource_attributes"),
        F.array().cast("array<string>").alias("resource_attributes_keys"),
        F.lit("").alias("scope_name"),
        F.lit("").alias("scope_version"),
        "span_attributes",
        attribute_keys(F.col("span_attributes")).alias("span_attributes_keys"),
        F.lit(1_000_000).cast("bigint").alias("duration_ns"),
        F.when(turn % 5 == 4, "Error").when(turn % 3 == 0, "Ok").otherwise("Unset").alias("status_code"),
        F.lit("").alias("status_message"),
        F.array().cast(_message_events_type()).alias("events"),
        F.array().cast(_links_type()).alias("links"),
    )


# --- annotations from ``labels`` and ``documents`` ---------------------------


def _annotated(doc: Column) -> list[Column]:
    conversation = F.expr("doc_id div 4")
    return [
        _text("chat-", conversation % 3).alias("service_name"),
        _text("c", conversation).alias("conversation_id"),
    ]


def _instant(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(BASE_SECONDS) + seconds)


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scores per label; up to four labels score the same conversation."""
    doc = F.col("doc_id")
    labelled = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id"
    )
    kinds = F.explode(
        F.array(
            F.struct(F.lit("quality").alias("eval_type"), F.col("quality").alias("score")),
            F.struct(F.lit("toxicity").alias("eval_type"), F.col("toxic").alias("score")),
        )
    )
    return labelled.select("*", kinds.alias("s")).select(
        uuid_text(doc % 2).alias("monitor_uuid"),
        *_annotated(doc),
        F.col("s.eval_type").alias("eval_type"),
        F.col("s.score").cast("double").alias("score"),
        _text(F.col("lang"), ":", F.col("source")).alias("reasoning"),
        uuid_text(F.expr("doc_id div 50")).alias("batch_id"),
        _instant(doc * 15 - 5).alias("scored_at"),
    )


def cluster_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return gate_cluster_keys(
        table(spark, sf_dir, "documents").select(
            uuid_text(doc % 2).alias("space_uuid"),
            *_annotated(doc),
            F.lit(1).cast("bigint").alias("taxonomy_version"),
            _text("topic-", F.col("lang")).alias("predicted_cluster_key"),
            (F.col("n_chars") % 100 / 100).cast("float").alias("confidence"),
            uuid_text(F.expr("doc_id div 50")).alias("batch_id"),
            _instant(doc * 15 + 30).alias("classified_at"),
        ),
        MIN_CONFIDENCE,
    )


# --- request queue from ``documents`` ----------------------------------------


def queue_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        uuid_text(F.expr("doc_id div 50")).alias("batch_id"),
        uuid_text(doc).alias("row_id"),
        _text("model-", F.col("lang")).alias("model_id"),
        F.col("text").alias("prompt"),
        F.when(doc % 2 == 0, '{"t":0}').alias("params"),
        F.lit(None).cast("string").alias("tool_config"),
        _instant(doc).alias("created_at"),
    )


def queue_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to all rows of every other batch and two thirds of the others."""
    doc, batch = F.col("doc_id"), F.expr("doc_id div 50")
    failed = doc % 10 == 7
    return (
        table(spark, sf_dir, "documents")
        .where((doc % 3 != 0) | (batch % 2 == 0))
        .select(
            uuid_text(batch).alias("batch_id"),
            uuid_text(doc).alias("row_id"),
            F.when(failed, "").otherwise(_text("ok ", doc)).alias("response"),
            F.when(failed, "failed").otherwise("complete").alias("status"),
            F.when(failed, "overloaded").alias("error"),
            _instant(doc + 5).alias("created_at"),
        )
    )


def queue_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending event per batch; every third one is complete in the same second."""
    batch = F.expr("doc_id div 50")
    counted = table(spark, sf_dir, "documents").groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("total_rows")
    )
    zero = F.lit(0).cast("bigint")
    statuses = F.when(
        F.col("batch") % 3 == 0, F.array(F.lit("pending"), F.lit("complete"))
    ).otherwise(F.array(F.lit("pending")))
    return counted.select("*", F.explode(statuses).alias("status")).select(
        uuid_text(F.col("batch")).alias("batch_id"),
        "status",
        "total_rows",
        F.when(F.col("status") == "complete", F.col("total_rows")).otherwise(zero).alias("completed_rows"),
        zero.alias("failed_rows"),
        _instant(F.col("batch")).alias("created_at"),
    )
