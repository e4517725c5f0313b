import json

import pytest

from spanloom.functions import attribute_keys as K
from spanloom.operators.normalize import normalize_spans
from spanloom.operators.turns import to_turns

SESSION = {"session.id": "c1"}


def flat(kind, content):
    return {"type": kind, "content": content}


def wrapped(kind, content):
    return {"kwargs": {"type": kind, "content": content}}


@pytest.fixture(scope="module")
def turn(make_raw):
    def run(messages_in=None, messages_out=None, attrs=None, **span):
        attrs = dict(SESSION if attrs is None else attrs)
        if messages_in is not None:
            attrs[K.ENTITY_INPUT] = (
                messages_in if isinstance(messages_in, str)
                else json.dumps({"inputs": {"messages": messages_in}})
            )
        if messages_out is not None:
            attrs[K.ENTITY_OUTPUT] = (
                messages_out if isinstance(messages_out, str)
                else json.dumps({"outputs": {"messages": messages_out}})
            )
        return to_turns(normalize_spans(make_raw({"attrs": attrs, **span}))).first()

    return run


def texts(row):
    return row.user_input, row.agent_response


def test_flat_human_and_wrapped_ai(turn):
    row = turn([flat("human", "hi"), flat("system", "s")], [wrapped("ai", "hello"), wrapped("tool", "t")])
    assert texts(row) == ("hi", "hello")


def test_last_message_of_its_kind_counts(turn):
    row = turn(
        [flat("human", "old"), wrapped("human", "new")], [wrapped("ai", "draft"), wrapped("ai", "final")]
    )
    assert texts(row) == ("new", "final")


def test_blocks_join_their_text_parts(turn):
    blocks = [
        {"type": "text", "text": "a"}, {"type": "tool_use", "text": "no"},
        {"type": "text", "text": "b"}, {"type": "text"}, "loose",
    ]
    assert turn([], [wrapped("ai", blocks)]).agent_response == "a\nb\n"


def test_flat_ai_message_is_chosen_but_has_no_text(turn):
    assert turn([], [wrapped("ai", "x"), flat("ai", "y")]).agent_response == ""


def test_block_array_from_a_human_is_empty(turn):
    assert turn([flat("human", [{"type": "text", "text": "q"}])], []).user_input == ""


def test_missing_side_and_bad_json_degrade(turn):
    assert texts(turn([flat("human", "hi")])) == ("hi", "")
    assert texts(turn(None, [wrapped("ai", "yo")])) == ("", "yo")
    assert texts(turn("{broken", "[1, 2]")) == ("", "")
    assert texts(turn('{"inputs": {"messages": {"type": "human"}}}', "")) == ("", "")


def test_gates(turn):
    assert turn() is None
    assert turn([], attrs={}) is None
    assert turn([], parent="aa") is None
    assert turn([]) is not None


def test_heavy_payloads_are_dropped_but_still_listed(turn):
    row = turn([], [])
    assert set(row.span_attributes) == {"session.id"}
    assert set(row.span_attributes_keys) == {"session.id", K.ENTITY_INPUT, K.ENTITY_OUTPUT}
