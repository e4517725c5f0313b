"""Compare a query with its oracle, row by row and regardless of order."""

from __future__ import annotations

import collections
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(spark, con, name, query, sql, sf_dir) -> str | None:
    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    expected_rel = con.sql(sql)
    if sorted(expected_rel.columns) != columns:
        return f"{name}: columns {columns} != {sorted(expected_rel.columns)}"
    expected = expected_rel.select(*(f'"{c}"' for c in columns)).fetchall()
    got, want = collections.Counter(rows), collections.Counter(expected)
    if got == want:
        return None if rows else f"{name}: both empty"
    extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
    return f"{name}: {len(rows)} rows, expected {len(expected)}\n  extra {extra}\n  missing {missing}"


def main(sf_dir: str, only: list[str]) -> None:
    from spanloom.plans.oracles import ORACLES
    from spanloom.plans.queries import QUERIES
    from spanloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            problem = difference(spark, con, name, query, ORACLES[name], sf_dir)
        except Exception as error:
            problem = f"{name}: {type(error).__name__} {str(error)[:600]}"
        print("FAIL" if problem else "ok", f"{name} {time.time() - began:.1f}s", problem or "", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
