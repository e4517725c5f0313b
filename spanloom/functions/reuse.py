"""Column lists that are built once per Spark application.

A column is an immutable description, so one that depends on nothing but
constants can be used in any number of queries. Composing the long ones takes
thousands of calls into the JVM, which is worth doing once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column


def built_once(build: Callable[[], list[Column]]) -> Callable[[], list[Column]]:
    built: dict[str, list[Column]] = {}

    @functools.wraps(build)
    def columns() -> list[Column]:
        application = SparkContext.getOrCreate().applicationId
        if application not in built:
            built.clear()
            built[application] = build()
        return built[application]

    return columns
