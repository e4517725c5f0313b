"""User and agent text from the JSON a root span carries.

Messages come flat (``{"type": "human", "content": ...}``) or wrapped
(``{"kwargs": {"type": ..., "content": ...}}``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.attributes import let, non_empty, strict_string


def message_array(text: Column, side: str) -> Column:
    """Messages under ``<side>.messages`` as variants; ``[]`` if there are none."""
    parsed = F.from_json(text, f"struct<{side}: struct<messages: array<variant>>>")
    return F.coalesce(parsed[side]["messages"], F.array().cast("array<variant>"))


def _at(message: Column, path: str) -> Column:
    return F.try_variant_get(message, path, "variant")


def _string_at(message: Column, path: str) -> Column:
    return F.coalesce(strict_string(_at(message, path)), F.lit(""))


def last_message(messages: Column, kind: str) -> Column:
    """Last message of this type in either shape, NULL if there is none."""
    of_kind = F.filter(
        messages,
        lambda m: (_string_at(m, "$.type") == kind) | (_string_at(m, "$.kwargs.type") == kind),
    )
    return F.try_element_at(of_kind, F.lit(-1))


def user_input(entity_input: Column) -> Column:
    human = last_message(message_array(entity_input, "inputs"), "human")
    return let(
        {"human": human},
        lambda m: F.coalesce(
            non_empty(_string_at(m["human"], "$.content")),
            _string_at(m["human"], "$.kwargs.content"),
        ),
    )


def agent_response(entity_output: Column) -> Column:
    """Text of the last agent message; only the wrapped shape has content."""
    answer = last_message(message_array(entity_output, "outputs"), "ai")

    def text(m: Column) -> Column:
        blocks = F.try_variant_get(m["content"], "$", "array<variant>")
        texts = F.transform(
            F.filter(blocks, lambda b: _string_at(b, "$.type") == "text"),
            lambda b: _string_at(b, "$.text"),
        )
        return F.when(
            F.schema_of_variant(m["content"]).startswith("ARRAY"), F.array_join(texts, "\n")
        ).otherwise(F.coalesce(strict_string(m["content"]), F.lit("")))

    return let({"content": _at(answer, "$.kwargs.content")}, text)
