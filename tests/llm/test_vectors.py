"""Graph search and whitening: against brute force and dense linear algebra, and odd tables."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import hnsw, whitening
from spanloom.llm.queries import QUERIES
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def table(spark):
    return [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Hot, repeated, null, zero and non-finite vectors, of two sizes, with clashing columns."""
    rng = np.random.default_rng(2)
    rows: list[tuple] = [(i, rng.standard_normal(6).tolist(), 0) for i in range(150)]
    hot = [1.0, 2.0, -1.0, 0.5, 0.25, 3.0]
    rows += [(1000 + i, hot, 0) for i in range(200)]
    rows += [(7, rows[7][1], 0), (8, hot, 0), (None, hot, 0), (2000, None, 0), (2020, [0.0] * 6, 0), (2040, [], 0)]
    rows += [(2060, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (2080, [math.nan] * 6, 0), (2100, [math.inf] * 6, 0)]
    rows += [(3000 + i, [float(i), 1.0, -float(i % 3)], 0) for i in range(12)]
    rows += [(4000, [3e38] * 6, 0), (4020, [1e-38] * 6, 0), (4040, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    return rows, df.withColumns({c: F.lit("mine") for c in ("shard", "part", "dims", "ids", "score", "values", "n", "c")})


def usable(rows):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    return {(i, tuple(np.float32(x).item() for x in v)) for i, v, *_ in rows if i is not None and good(v)}


def neighbours(rows, every: int, k: int):
    """{query_id: [(vec_id, score)]}, best first."""
    kept = usable(rows)
    out = {}
    for q, a in kept:
        if q % every == 0:
            best = out.setdefault(q, {})
            for v, b in kept:
                if v != q and len(a) == len(b):
                    s = float((np.array(a) * np.array(b)).sum())
                    best[v] = max(best.get(v, -math.inf), s)
    return {q: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for q, best in out.items() if best}


def test_graph_finds_nearest():
    vectors = np.random.default_rng(0).standard_normal((3000, 16)) * np.random.default_rng(1).random((3000, 1))
    graph = hnsw.build(hnsw.lifted(vectors))
    assert graph.sizes[0] == 3000 and len(graph.sizes) > 2
    assert all(x.max() < s and (x >= -1).all() for x, s in zip(graph.neighbours, graph.sizes, strict=True))
    queries = vectors[::30]
    found = hnsw.search(graph, np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32), 60)
    best = np.argsort(-(queries @ vectors.T), axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(best, found, strict=True)])
    assert recall > 0.95


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_small_graphs_hold_all(n):
    vectors = np.random.default_rng(n).standard_normal((n, 4))
    found = hnsw.search(hnsw.build(hnsw.lifted(vectors)), np.ones((2, 5), dtype=np.float32), 50)
    assert sorted(x for x in found[0].tolist() if x >= 0) == list(range(n))


def test_search_query(spark, table):
    found = QUERIES["op11_nearest_neighbours"](spark, SF_DIR)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    expected, got = neighbours(table, 20, 20), defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(expected) and all(len(x) == 20 for x in got.values())
    vectors = dict(table)
    for q, listed in got.items():
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, float(np.dot(np.array(vectors[q], float), np.array(vectors[v], float))), abs_tol=1e-12) for v, s in listed)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in expected)
    assert hits >= 0.95 * sum(map(len, expected.values()))


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_odd_vectors(spark, odd, shard_rows):
    rows, df = odd
    vectors = hnsw.usable(df)
    found = hnsw.nearest(hnsw.index(vectors, 10, shard_rows), vectors.where("vec_id % 20 = 0"), 10)
    got = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    expected = {q: [v for v, _ in x] for q, x in neighbours(rows, 20, 10).items()}
    # So small a graph is searched whole.
    assert dict(got) == expected
    assert got[1000] and 1000 not in got[1000]


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    vectors = hnsw.usable(none)
    assert hnsw.nearest(hnsw.index(vectors, 5), vectors, 5).collect() == []
    x = none.select("vec_id", whitening.integers().alias("x"))
    assert whitening.whiten(x, whitening.fit(x)).collect() == []


def symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    [3.0], [5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5], list(range(1, 41)), [10.0 ** -k for k in range(12)],
    [2, 2, 2, 1, 1, 0, 0], [1 + 1e-7 * k for k in range(30)], [-3, -1, 0.5, 2],
])
def test_eigenpairs(values):
    a = symmetric(values, 4)
    wanted = min(len(values), 9)
    assert whitening.inertia(a - 1.5 * np.eye(len(a))) == sum(v < 1.5 for v in values)
    found = [whitening.eigenpairs(a, i) for i in whitening.intervals(a, wanted)]
    got = np.concatenate([v for v, _ in found])
    assert len(got) >= wanted
    assert np.allclose(got[:wanted], sorted(values, reverse=True)[:wanted], rtol=0, atol=1e-13 * max(map(abs, values)) * len(values))
    for v, x in found:
        assert np.abs(a @ x - x * v).max() <= 1e-12 * np.abs(a).sum()


def test_inertia_needs_pairs_of_rows():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.inertia(np.zeros((3, 3))) == 0
    rng = np.random.default_rng(9)
    for n in range(1, 30):
        a = rng.standard_normal((n, n))
        a = a + a.T - np.diag(np.diag(a + a.T))
        assert whitening.inertia(a) == int((np.linalg.eigvalsh(a) < 0).sum())


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (10, 2**24, 2**40):
        z = rng.integers(-size, size, (5000, 3))
        plain = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) for j in range(3)] for i in range(3)]
        assert whitening._products(z).tolist() == plain


def check_whitening(rows, x, components):
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) against dense algebra on exact covariances."""
    n, dims = x.shape
    sums = [sum(int(v) for v in x[:, i]) for i in range(dims)]
    scaled = np.array([[n * int(v) - s for v, s in zip(row, sums, strict=True)] for row in x], dtype=object)
    cov = np.array([[float(Fraction(int(sum(scaled[:, i] * scaled[:, j])), n**3)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    centred = scaled.astype(float) / n
    got = np.full((n, len(values)), np.nan)
    for r in rows:
        got[r["row"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in scaled[r["row"]])
        assert math.isclose(r["explained"], values[r["component"] - 1] / np.trace(cov), rel_tol=1e-9)
        assert r["identity_error"] <= 1e-9
    expected = centred @ (vectors / np.sqrt(values))
    signs = np.sign((got * expected).sum(axis=0))
    assert np.allclose(got, expected * signs, atol=1e-6)
    assert np.abs(got.T @ got / n - np.eye(len(values))).max() < 1e-9


def test_whitening_query(spark, table):
    found = QUERIES["op12_whitening"](spark, SF_DIR)
    kinds = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint"}
    assert dict(found.dtypes) == kinds | dict.fromkeys(["whitened", "explained", "identity_error"], "double")
    order = {i: k for k, (i, _) in enumerate(table)}
    x = np.floor(64 * np.array([v for _, v in table], dtype=np.float64)).astype(np.int64) + 1_000_000
    rows = [r.asDict() | {"row": order[r.vec_id]} for r in found.collect()]
    assert len(rows) == 32 * len(table)
    check_whitening(rows, x, 32)


def test_whitening_odd_vectors(spark, odd):
    rows, df = odd
    vectors = df.withColumn("x", whitening.integers()).withColumn("whitening", F.lit("mine"))
    models = whitening.fit(vectors, 4)
    got = whitening.whiten(vectors, models).select("vec_id", "x", "shard", "whitening").collect()
    left = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    assert len(got) == len(left) and {r.vec_id for r in got} == {r[0] for r in left} and all(r.shard == "mine" for r in got)
    assert {d: m.n for d, m in models.items()} == {0: 1, 3: 12, 6: len(left) - 13}
    assert [r.whitening.components for r in got if r.vec_id == 2040] == [[]]
    three = [r for r in got if len(r.x) == 3]
    # One entry is constant, so one component has no variance.
    assert all(len(r.whitening.components) == 2 for r in three)
    listed = [c.asDict() | {"row": k, "n": r.whitening.n, "deviation": r.whitening.deviation, "identity_error": r.whitening.identity_error}
              for k, r in enumerate(three) for c in r.whitening.components]
    check_whitening(listed, np.array([r.x for r in three]), 2)
    # 3e38 counts as the largest entry there is, whose square fits no long.
    assert [r.whitening.deviation for r in got if r.vec_id == 4000] == [None]


def test_one_and_equal_vectors_have_no_components(spark):
    for many in (1, 5):
        vectors = spark.createDataFrame([(i, [1.5, 2.5]) for i in range(many)], "vec_id long, embedding array<float>")
        vectors = vectors.withColumn("x", whitening.integers())
        got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
        assert [(r.whitening.n, r.whitening.deviation, r.whitening.components) for r in got] == [(many, 0, [])] * many
