import pytest

from spanloom.functions import attribute_keys as K
from spanloom.operators.normalize import normalize_spans


@pytest.fixture(scope="module")
def normalized(make_raw):
    return lambda **span: normalize_spans(make_raw(span)).first()


@pytest.mark.parametrize(
    "status, code", [("Error", 2), ("Ok", 1), ("Unset", 0), ("ERROR", None), ("", None)]
)
def test_status(normalized, status, code):
    assert normalized(status=status).status_code == code


def test_times_keep_nanoseconds(normalized):
    row = normalized(start=1_704_153_599_999_999_999, duration=2)
    assert row.start_ns == 1_704_153_599_999_999_999
    assert row.end_ns == 1_704_153_600_000_000_001
    assert str(row.date) == "2024-01-01"
    assert row.start_time.microsecond == 999_999 and row.end_time.microsecond == 0


def test_first_exception_event(normalized):
    events = [
        ("x", {K.EXCEPTION_TYPE: "no"}),
        ("exception", {K.EXCEPTION_TYPE: "A", K.EXCEPTION_MESSAGE: "m"}),
        ("exception", {K.EXCEPTION_TYPE: "B"}),
    ]
    row = normalized(events=events)
    assert (row.exception_type, row.exception_message) == ("A", "m")
    row = normalized()
    assert (row.exception_type, row.exception_message) == ("", "")


@pytest.mark.parametrize(
    "column, keys",
    [
        ("model", K.MODEL_KEYS),
        ("workflow", K.WORKFLOW_KEYS),
        ("task", K.TASK_KEYS),
        ("conversation_id", K.CONVERSATION_KEYS),
    ],
)
def test_first_non_empty_key_wins(normalized, column, keys):
    assert normalized()[column] == ""
    for i in range(len(keys)):
        attrs = {k: "" for k in keys[:i]} | {k: f"v{n}" for n, k in enumerate(keys) if n >= i}
        assert normalized(attrs=attrs)[column] == f"v{i}"
    assert normalized(attrs={keys[-1]: 12})[column] == "12"


@pytest.mark.parametrize(
    "value, tokens",
    [(0, 0), ("12", 12), ("abc", None), (-1, None), (2**32 - 1, 2**32 - 1), (2**32, None), (None, None)],
)
def test_tokens(normalized, value, tokens):
    row = normalized(attrs={k: value for k in (K.PROMPT_TOKEN_KEYS[-1], K.TOTAL_TOKEN_KEYS[1])})
    assert row.prompt_tokens == tokens and row.total_tokens == tokens
    assert row.completion_tokens is None


def test_zero_tokens_stop_the_search(normalized):
    attrs = dict(zip(K.COMPLETION_TOKEN_KEYS, (0, 5, 6, 7)))
    assert normalized(attrs=attrs).completion_tokens == 0


def test_flags(normalized):
    row = normalized()
    assert (row.is_llm_call, row.is_tool_call) == (False, False)
    assert normalized(attrs={K.MODEL_KEYS[2]: "m"}).is_llm_call
    assert normalized(attrs={"gen_ai.operation.name": "chat"}).is_llm_call
    for key, value in K.TOOL_MARKERS:
        assert normalized(attrs={key: value}).is_tool_call
        assert not normalized(attrs={key: value.swapcase()}).is_tool_call


def test_no_shuffle(make_raw):
    plan = normalize_spans(make_raw({}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
