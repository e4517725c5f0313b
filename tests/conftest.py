from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from spanloom.session import local_session  # noqa: E402
from spanloom.sources.tables import ATTRS, EVENTS, LINKS, Store  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="spanloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    name = "t" + tmp_path.name.replace("-", "_")
    return Store(spark, name, str(tmp_path / "db")).ensure_tables()


@pytest.fixture(scope="session")
def make_raw(spark):
    """Raw spans from dicts; ``attrs`` and events' attributes are plain JSON."""

    def build(*spans: dict):
        rows = []
        for i, span in enumerate(spans):
            rows.append(
                (
                    span.get("start", 1_704_067_200_000_000_000 + i),
                    span.get("trace", f"{i:032x}"),
                    span.get("id", f"{i:016x}"),
                    span.get("parent", ""),
                    span.get("service", "svc"),
                    span.get("duration", 5),
                    span.get("status", "Unset"),
                    span.get("name", "span"),
                    json.dumps(span.get("attrs", {})),
                    json.dumps(
                        [
                            {"timestamp_ns": 0, "name": name, "attributes": attributes}
                            for name, attributes in span.get("events", [])
                        ]
                    ),
                )
            )
        df = spark.createDataFrame(
            rows,
            "timestamp_ns bigint, trace_id string, span_id string, parent_span_id string,"
            " service_name string, duration_ns bigint, status_code string, span_name string,"
            " attrs string, events string",
        )
        attrs = F.from_json("attrs", ATTRS)
        empty = F.lit("")
        return df.select(
            "timestamp_ns", "trace_id", "span_id", "parent_span_id",
            empty.alias("trace_state"), "span_name", F.lit("Internal").alias("span_kind"),
            "service_name", F.expr(f"cast(map() AS {ATTRS})").alias("resource_attributes"),
            F.array().cast("array<string>").alias("resource_attributes_keys"),
            empty.alias("scope_name"), empty.alias("scope_version"),
            attrs.alias("span_attributes"), F.map_keys(attrs).alias("span_attributes_keys"),
            "duration_ns", "status_code", empty.alias("status_message"),
            F.from_json("events", EVENTS).alias("events"),
            F.expr(f"cast(array() AS {LINKS})").alias("links"),
        )

    return build
