"""Message discovery and text, one case per rule."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import messages
from spanloom.operators.normalize import normalize_spans, spans_view


@pytest.fixture(scope="module")
def extract(make_raw):
    def run(attrs=None, events=()):
        row = normalize_spans(make_raw({"attrs": attrs or {}, "events": list(events)})).first()
        prompts = [(m.position, m.role, m.message) for m in row.prompts]
        completions = [
            (m.position, m.role, m.message, [tuple(t) for t in m.tool_calls]) for m in row.completions
        ]
        assert row.has_prompts == bool(prompts) and row.has_completions == bool(completions)
        return prompts, completions

    return run


def test_no_messages(extract):
    assert extract() == ([], [])


def test_positions_sort_as_numbers_and_keep_gaps(extract):
    attrs = {f"gen_ai.prompt.{n}.role": "user" for n in (10, 2, 0)}
    attrs |= {f"gen_ai.prompt.{n}.content": f"t{n}" for n in (10, 2, 0)}
    assert extract(attrs)[0] == [(0, "user", "t0"), (2, "user", "t2"), (10, "user", "t10")]


def test_content_without_role_is_no_message(extract):
    assert extract({"gen_ai.prompt.0.content": "x", "llm.output_messages.1.message.content": "y"}) == ([], [])


@pytest.mark.parametrize("content", [7, True, ["a"], {"a": 1}, None])
def test_only_strings_count_as_content(extract, content):
    attrs = {"gen_ai.prompt.0.role": "user", "gen_ai.prompt.0.content": content}
    assert extract(attrs)[0] == [(0, "user", "")]


def test_dialects_merge_by_position_and_semconv_wins(extract):
    attrs = {
        "gen_ai.prompt.0.role": "system", "gen_ai.prompt.0.content": "first",
        "llm.input_messages.0.message.role": "user", "llm.input_messages.0.message.content": "second",
        "llm.input_messages.1.message.role": "tool", "llm.input_messages.1.message.content": "third",
    }
    assert extract(attrs)[0] == [(0, "system", "first"), (1, "tool", "third")]


def test_empty_text_falls_through_to_the_next_dialect(extract):
    attrs = {
        "gen_ai.prompt.0.role": "", "gen_ai.prompt.0.content": "",
        "llm.input_messages.0.message.content": "second",
        "llm.input_messages.0.message.role": "",
    }
    assert extract(attrs)[0] == [(0, "user", "second")]


def test_events_give_positions_and_texts(extract):
    events = [
        ("gen_ai.choice", {"message": "m0"}),
        ("gen_ai.user.message", {"content": "q0"}),
        ("other", {"content": "no"}),
        ("gen_ai.assistant.message", {"message": "not this", "content": "c1"}),
        ("gen_ai.user.message", {"content": 5}),
    ]
    prompts, completions = extract(events=events)
    assert prompts == [(0, "user", "q0"), (1, "user", "5")]
    assert completions == [(0, "assistant", "m0", []), (1, "assistant", "c1", [])]


def test_event_text_is_found_by_ordinal_for_other_dialects_too(extract):
    attrs = {"gen_ai.prompt.1.role": "user"}
    events = [("gen_ai.user.message", {"content": "a"}), ("gen_ai.user.message", {"content": "b"})]
    assert extract(attrs, events)[0] == [(0, "user", "a"), (1, "user", "b")]


def test_native_text_only_at_position_zero(extract):
    attrs = {
        "snow.ai.observability.agent.planning.query": "plan",
        "gen_ai.prompt.1.role": "user",
        "snow.ai.observability.agent.planning.thinking_response": "think",
        "snow.ai.observability.agent.tool.cortex_analyst.text": "later",
    }
    prompts, completions = extract(attrs)
    assert prompts == [(0, "user", "plan"), (1, "user", "")]
    assert completions == [(0, "assistant", "think", [])]


def test_tool_calls_of_both_dialects(extract):
    attrs = {
        "gen_ai.completion.0.role": "assistant",
        "gen_ai.completion.0.tool_calls.10.name": "ten",
        "gen_ai.completion.0.tool_calls.2.name": "two",
        "gen_ai.completion.0.tool_calls.2.id": "i2",
        "gen_ai.completion.0.tool_calls.2.arguments": '{"a": 1}',
        "gen_ai.completion.0.tool_calls.3.id": "no name",
        "gen_ai.completion.10.role": "assistant",
        "gen_ai.completion.10.tool_calls.0.name": "other message",
        "llm.output_messages.1.message.role": "assistant",
        "llm.output_messages.1.message.tool_calls.0.tool_call.id": "oi",
        "llm.output_messages.1.message.tool_calls.0.tool_call.function.name": "f",
        "llm.output_messages.1.message.tool_calls.0.tool_call.function.arguments": "{}",
        "llm.output_messages.1.message.tool_calls.1.tool_call.function.name": "no id",
    }
    assert extract(attrs)[1] == [
        (0, "assistant", "", [("i2", "two", '{"a": 1}'), ("", "ten", "")]),
        (1, "assistant", "", [("oi", "f", "{}")]),
        (10, "assistant", "", [("", "other message", "")]),
    ]


def test_leading_zeros_name_a_position_but_not_its_text(extract):
    attrs = {
        "gen_ai.prompt.00.role": "system", "gen_ai.prompt.00.content": "x",
        "gen_ai.prompt.0.role": "user",
        "gen_ai.prompt.99999999999.role": "far", "gen_ai.prompt.99999999999.content": "kept",
    }
    assert extract(attrs)[0] == [(0, "user", ""), (99999999999, "far", "kept")]


def test_indices_are_sorted_and_distinct(make_raw):
    raw = make_raw(
        {
            "attrs": {"gen_ai.prompt.3.role": "a", "gen_ai.prompt.0.role": "b",
                      "llm.input_messages.3.message.role": "c"},
            "events": [("gen_ai.user.message", {})] * 2,
        }
    )
    attrs, events = F.col("span_attributes"), F.col("events")
    row = raw.select(
        messages.prompt_indices(attrs, events).alias("p"),
        messages.completion_indices(attrs, events).alias("c"),
    ).first()
    assert row.p == [0, 1, 3] and row.c == []


def test_flags_follow_array_order(make_raw):
    attrs = {f"gen_ai.prompt.{n}.role": "user" for n in (4, 7, 9)}
    row = spans_view(normalize_spans(make_raw({"attrs": attrs}))).first()
    assert [(m.is_start, m.is_end, m.position) for m in row.prompts] == [
        (True, False, 4), (False, False, 7), (False, True, 9)
    ]
    assert row.prompts[0].__fields__ == ["is_end", "is_start", "message", "position", "role"]
    assert row.completions == []
