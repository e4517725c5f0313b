"""Reads from a flat ``MAP<STRING, VARIANT>`` of span attributes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT32_MAX = 2**32 - 1


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def as_string(value: Column) -> Column:
    """Variant as text: numbers and booleans are printed, arrays become JSON."""
    return F.try_variant_get(value, "$", "string")


def strict_string(value: Column) -> Column:
    """Variant as text only if it *is* a string, else NULL."""
    return F.when(F.schema_of_variant(value) == "STRING", as_string(value))


def as_uint32(value: Column) -> Column:
    """Variant as an unsigned 32-bit number, NULL if it is not one."""
    number = F.try_variant_get(value, "$", "bigint")
    return F.when(number.between(0, UINT32_MAX), number)


def string_attr(attrs: Column, key: str | Column) -> Column:
    return as_string(attrs[key])


def first_non_empty(attrs: Column, keys: Sequence[str]) -> Column:
    """Text of the first key that is set and not empty, else ``''``."""
    return F.coalesce(*(non_empty(string_attr(attrs, k)) for k in keys), F.lit(""))


def first_uint32(attrs: Column, keys: Sequence[str]) -> Column:
    """First key that holds a number; zero counts, NULL if there is none."""
    return F.coalesce(*(as_uint32(attrs[k]) for k in keys))


def attr_equals(attrs: Column, key: str, expected: str) -> Column:
    return F.coalesce(string_attr(attrs, key), F.lit("")) == expected


def attribute_keys(attrs: Column) -> Column:
    return F.coalesce(F.map_keys(attrs), F.array().cast("array<string>"))


def without_keys(attrs: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(attrs, lambda k, _: ~k.isin(*keys))


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``values`` once and hand them to ``body`` as one struct.

    Lambda bodies get no common-subexpression elimination, so whatever is used
    several times inside one is bound here first.
    """
    bound = F.struct(*(v.alias(name) for name, v in values.items()))
    return F.get(F.transform(F.array(bound), body), F.lit(0))
