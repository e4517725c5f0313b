"""Prompt, completion and tool-call messages of one span.

Four instrumentation dialects describe messages: numbered ``gen_ai.*`` keys,
numbered ``llm.*_messages`` keys, span events, and single-value native keys.
A span may mix them; messages merge by their number.

All functions take and return columns and look at one row only, so the same
code runs in batch and in a stream. Keys are parsed once per span into small
number-keyed maps; the per-message lambdas then look numbers up in these
instead of searching the whole attribute map.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import attribute_keys as K
from spanloom.functions.attributes import (
    first_non_empty,
    let,
    non_empty,
    strict_string,
    string_attr,
)

# A number as it is written when a key is built from it: no leading zeros.
PLAIN_NUMBER = r"(0|[1-9]\d*)"
ANY_NUMBER = r"(\d+)"

TOOL_CALLS_TYPE = "array<struct<id: string, name: string, arguments: string>>"


def _no_positions() -> Column:
    return F.array().cast("array<bigint>")


def _key_pattern(prefix: str, number: str, suffix: str) -> str:
    return f"^{re.escape(prefix)}{number}{re.escape(suffix)}$"


def _own_entries(attrs: Column, semconv: str, openinference: str) -> Column:
    """Entries of the two numbered dialects. Most spans have none or few, so
    the pattern matching that follows works on short lists."""
    return F.filter(
        F.map_entries(attrs),
        lambda e: e["key"].startswith(semconv) | e["key"].startswith(openinference),
    )


def _numbered_positions(entries: Column, prefix: str, suffix: str) -> Column:
    pattern = _key_pattern(prefix, ANY_NUMBER, suffix)
    matching = F.filter(entries, lambda e: e["key"].rlike(pattern))
    return F.transform(matching, lambda e: F.regexp_extract(e["key"], pattern, 1).try_cast("bigint"))


def _numbered_strings(entries: Column, prefix: str, suffix: str) -> Column:
    """``MAP<BIGINT, STRING>`` of the string values under ``<prefix><n><suffix>``."""
    pattern = _key_pattern(prefix, PLAIN_NUMBER, suffix)
    matching = F.filter(entries, lambda e: e["key"].rlike(pattern))
    numbered = F.transform(
        matching,
        lambda e: F.struct(
            F.regexp_extract(e["key"], pattern, 1).try_cast("bigint").alias("number"),
            strict_string(e["value"]).alias("value"),
        ),
    )
    return F.map_from_entries(F.filter(numbered, lambda e: e["number"].isNotNull()))


def matching_events(events: Column, names: Sequence[str]) -> Column:
    return F.filter(events, lambda e: e["name"].isin(*names))


def nth_event_attributes(events: Column, names: Sequence[str], n: Column | int) -> Column:
    """Attributes of the n-th (from 0) event with one of ``names``, else NULL."""
    index = F.lit(n) if isinstance(n, int) else n
    return F.get(matching_events(events, names), index)["attributes"]


def _ordinals(items: Column) -> Column:
    """``[0, 1, ...]``, one number per item."""
    return F.transform(items, lambda _, i: i.cast("bigint"))


def _native_position(native_text: Column) -> Column:
    return F.when(native_text != "", F.array(F.lit(0).cast("bigint"))).otherwise(_no_positions())


def _sorted_union(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*arrays))))


@dataclass(frozen=True)
class Side:
    """Where the dialects keep one side of the exchange."""

    semconv: str
    openinference: str
    events: tuple[str, ...]
    event_text: tuple[str, ...]
    native: tuple[str, ...]
    default_role: str

    def bound(self, attrs: Column, events: Column) -> dict[str, Column]:
        return {
            "own": _own_entries(attrs, self.semconv, self.openinference),
            "event_text": _event_texts(events, self.events, self.event_text),
            "native_text": first_non_empty(attrs, self.native),
        }

    def indices(self, found: Column) -> Column:
        return _sorted_union(
            _numbered_positions(found["own"], self.semconv, ".role"),
            _numbered_positions(found["own"], self.openinference, ".message.role"),
            _ordinals(found["event_text"]),
            _native_position(found["native_text"]),
        )


PROMPTS = Side(
    K.SEMCONV_PROMPT, K.OPENINFERENCE_INPUT, K.PROMPT_EVENTS, K.EVENT_PROMPT_TEXT,
    K.NATIVE_PROMPT_KEYS, "user",
)
COMPLETIONS = Side(
    K.SEMCONV_COMPLETION, K.OPENINFERENCE_OUTPUT, K.COMPLETION_EVENTS, K.EVENT_COMPLETION_TEXT,
    K.NATIVE_COMPLETION_KEYS, "assistant",
)


def prompt_indices(attrs: Column, events: Column) -> Column:
    return let(PROMPTS.bound(attrs, events), PROMPTS.indices)


def completion_indices(attrs: Column, events: Column) -> Column:
    return let(COMPLETIONS.bound(attrs, events), COMPLETIONS.indices)


def _event_texts(events: Column, names: Sequence[str], text_keys: Sequence[str]) -> Column:
    """Text of each matching event; its place in the list is its number."""
    texts = F.transform(
        matching_events(events, names),
        lambda e: first_non_empty(e["attributes"], text_keys),
    )
    return F.coalesce(texts, F.array().cast("array<string>"))


def _messages(side: Side, attrs: Column, events: Column, with_tool_calls: bool) -> Column:
    fields_type = "struct<message: string, position: bigint, role: string>"
    if with_tool_calls:
        fields_type = fields_type[:-1] + f", tool_calls: {TOOL_CALLS_TYPE}>"

    def build(found: Column) -> Column:
        entries = found["own"]
        parsed = {
            "at": side.indices(found),
            "semconv_role": _numbered_strings(entries, side.semconv, ".role"),
            "semconv_text": _numbered_strings(entries, side.semconv, ".content"),
            "oi_role": _numbered_strings(entries, side.openinference, ".message.role"),
            "oi_text": _numbered_strings(entries, side.openinference, ".message.content"),
        }
        if with_tool_calls:
            parsed["tools"] = F.map_from_entries(
                F.filter(entries, lambda e: e["key"].contains(".tool_calls."))
            )

        def each(known: Column) -> Column:
            if not with_tool_calls:
                return F.transform(known["at"], lambda i: message(found, known, i))
            # Matched against the patterns once per span, not once per message.
            paired = {"pairs": _tool_pairs(known["tools"])}
            return let(paired, lambda p: F.transform(known["at"], lambda i: message(found, known, i, p["pairs"])))

        built = let(parsed, each)
        # Most spans of a trace (tools, chains, storage) carry no messages.
        carries_any = (
            (F.size(entries) > 0) | (F.size(found["event_text"]) > 0) | (found["native_text"] != "")
        )
        return F.when(carries_any, built).otherwise(F.array().cast(f"array<{fields_type}>"))

    def message(found: Column, known: Column, i: Column, pairs: Column | None = None) -> Column:
        text = F.coalesce(
            non_empty(known["semconv_text"][i]),
            non_empty(known["oi_text"][i]),
            non_empty(F.get(found["event_text"], i.try_cast("int"))),
            F.when(i == 0, found["native_text"]),
            F.lit(""),
        )
        role = F.coalesce(
            non_empty(known["semconv_role"][i]),
            non_empty(known["oi_role"][i]),
            F.lit(side.default_role),
        )
        fields = [text.alias("message"), i.alias("position"), role.alias("role")]
        if with_tool_calls:
            fields.append(tool_calls(known["tools"], i, pairs).alias("tool_calls"))
        return F.struct(*fields)

    return let(side.bound(attrs, events), build)


def prompts(attrs: Column, events: Column) -> Column:
    """``ARRAY<STRUCT<message, position, role>>`` in order of position."""
    return _messages(PROMPTS, attrs, events, with_tool_calls=False)


def completions(attrs: Column, events: Column) -> Column:
    """As :func:`prompts`, with the tool calls of each message."""
    return _messages(COMPLETIONS, attrs, events, with_tool_calls=True)


def _tool_positions(keys: Column, prefix: str, middle: str, suffix: str) -> Column:
    """Pairs (message number, tool-call number) named by the keys."""
    pattern = (
        f"^{re.escape(prefix)}{PLAIN_NUMBER}{re.escape(middle)}{ANY_NUMBER}{re.escape(suffix)}$"
    )
    return F.transform(
        F.filter(keys, lambda k: k.rlike(pattern)),
        lambda k: F.struct(
            F.regexp_extract(k, pattern, 1).try_cast("bigint").alias("message"),
            F.regexp_extract(k, pattern, 2).try_cast("bigint").alias("call"),
        ),
    )


def _tool_pairs(attrs: Column) -> Column:
    """All pairs (message number, tool-call number) of a span."""
    keys = F.map_keys(attrs)
    return F.concat(
        _tool_positions(keys, K.SEMCONV_COMPLETION, ".tool_calls.", ".name"),
        _tool_positions(keys, K.OPENINFERENCE_OUTPUT, ".message.tool_calls.", ".tool_call.id"),
    )


def _calls_of(pairs: Column, message: Column) -> Column:
    own = F.filter(pairs, lambda p: p["message"] == message)
    return _sorted_union(F.transform(own, lambda p: p["call"]))


def tool_call_indices(attrs: Column, message: Column) -> Column:
    """Sorted numbers of the tool calls that belong to one completion."""
    return _calls_of(_tool_pairs(attrs), message)


def tool_calls(attrs: Column, message: Column, pairs: Column | None = None) -> Column:
    """``ARRAY<STRUCT<id, name, arguments>>`` of one completion.

    ``pairs`` are :func:`_tool_pairs` of the span where they are known already.
    """

    def field(call: Column, semconv: str, openinference: str) -> Column:
        n, c = message.cast("string"), call.cast("string")
        first = F.concat(F.lit(K.SEMCONV_COMPLETION), n, F.lit(".tool_calls."), c, F.lit(semconv))
        second = F.concat(
            F.lit(K.OPENINFERENCE_OUTPUT), n, F.lit(".message.tool_calls."), c,
            F.lit(".tool_call." + openinference),
        )
        return F.coalesce(
            non_empty(strict_string(attrs[first])), non_empty(strict_string(attrs[second])), F.lit("")
        )

    calls = F.transform(
        tool_call_indices(attrs, message) if pairs is None else _calls_of(pairs, message),
        lambda t: F.struct(
            field(t, ".id", "id").alias("id"),
            field(t, ".name", "function.name").alias("name"),
            field(t, ".arguments", "function.arguments").alias("arguments"),
        ),
    )
    return F.when(F.size(attrs) > 0, calls).otherwise(F.array().cast(TOOL_CALLS_TYPE))


def message_flags(messages: Column, fields: Sequence[str]) -> Column:
    """Put ``is_end`` and ``is_start`` (by array order) in front of each message."""
    return F.transform(
        messages,
        lambda m, i: F.struct(
            (i == F.size(messages) - 1).alias("is_end"),
            (i == 0).alias("is_start"),
            *(m[f].alias(f) for f in fields),
        ),
    )


PROMPT_FIELDS = ("message", "position", "role")
COMPLETION_FIELDS = ("message", "position", "role", "tool_calls")


def exception_attr(events: Column, key: str) -> Column:
    """An attribute of the first exception event, ``''`` if there is none."""
    first = nth_event_attributes(events, (K.EXCEPTION_EVENT,), 0)
    return F.coalesce(string_attr(first, key), F.lit(""))
