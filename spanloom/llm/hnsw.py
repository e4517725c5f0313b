"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Distinct vectors are dealt to shards by hash, and every shard becomes one row: its
vectors, its graph as flat arrays of neighbour numbers, and the ids behind each
vector. The graph is hierarchical: a node reaches level l with probability
M^-l, nodes are numbered by falling level, so that level l is the first so many of
them, and a search descends from node 0. Neighbours are chosen for diversity: one
that is nearer to a neighbour already chosen than to the node itself is chosen
only if places are left.

Largest inner product becomes nearness by one more coordinate, which lifts all
vectors of a shard to the same length (and is 0 for queries).

Nodes are inserted, and queries answered, many at a time: each step expands the
best open entries of every beam in one batch of array operations.

Of equal vectors the k + 1 smallest ids are all that an answer can hold, so they
are one node with so many ids, whatever their number. Queries visit every shard
(grouped by shard and part, so that a group holds one shard's graph and a bounded
number of queries), and answers are merged by a window that cuts before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import arrays
from spanloom.llm.common import written

SHARD_ROWS = 8192
"""Distinct vectors in a shard, on average. Larger ones make searches cheaper and building slower; one must fit a task."""
PART_QUERIES = 4096
"""Queries that meet a shard at a time, on average."""
M = 16
"""Neighbours of a node on the levels above 0; on level 0 twice as many."""
BUILD_BEAM = 100
SEARCH_BEAM = 100
EXPANDED = 4
"""Entries of a beam expanded in one step."""
TOGETHER = 256
"""Nodes inserted, or queries answered, at a time."""


class Graph(NamedTuple):
    vectors: np.ndarray
    """[nodes, dims], of one length, in single precision: they steer the search only."""
    sizes: list[int]
    """Nodes on each level, from level 0."""
    neighbours: list[np.ndarray]
    """By level: [nodes, degree], -1 where there is none."""


def beam(graph: Graph, level: int, queries: np.ndarray, entries: np.ndarray, width: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes nearest to each query, as far as a search from ``entries`` finds them: [queries, width] numbers (-1: none) and scores, falling.

    Only the first ``upto`` nodes of the level are there yet.
    """
    many = len(queries)
    rows = np.arange(many)[:, None]
    neighbours = graph.neighbours[level]
    seen = np.zeros((many, upto + 1), dtype=bool)  # the last place stands for -1
    seen[:, upto] = True
    nodes = np.full((many, width), -1, dtype=np.int64)
    scores = np.full((many, width), -np.inf, dtype=np.float32)
    closed = np.ones((many, width), dtype=bool)
    nodes, scores, closed = _merged(graph, queries, nodes, scores, closed, entries, seen, rows)
    live = np.arange(many)
    while len(live):
        ready = np.where(closed[live], -np.inf, scores[live])
        pick = np.argpartition(-ready, min(EXPANDED, width) - 1, axis=1)[:, :EXPANDED]
        usable = np.take_along_axis(ready, pick, axis=1) > -np.inf
        going = usable.any(axis=1)
        live, pick, usable = live[going], pick[going], usable[going]
        if not len(live):
            break
        at = live[:, None]
        closed[at, pick] |= usable
        found = neighbours[np.where(usable, nodes[at, pick], 0)]
        found = np.where(usable[:, :, None], found, -1).reshape(len(live), -1)
        out = _merged(graph, queries[live], nodes[live], scores[live], closed[live], found, seen, at)
        nodes[live], scores[live], closed[live] = out
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _merged(graph, queries, nodes, scores, closed, found, seen, rows):
    """Beams with the entries of ``found`` that were not seen before, each as wide as it was."""
    width = nodes.shape[1]
    found = np.sort(found, axis=1)
    fresh = ~seen[rows, found]
    fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
    seen[rows, found] = True
    a, b = np.nonzero(fresh)
    value = np.full(found.shape, -np.inf, dtype=np.float32)
    value[a, b] = np.einsum("ij,ij->i", graph.vectors[found[a, b]], queries[a])
    every = np.concatenate([scores, value], axis=1)
    best = np.argpartition(-every, width - 1, axis=1)[:, :width]
    take = lambda x, y: np.take_along_axis(np.concatenate([x, y], axis=1), best, axis=1)
    kept = np.take_along_axis(every, best, axis=1)
    none = kept == -np.inf
    return np.where(none, -1, take(nodes, found)), kept, take(closed, np.zeros_like(fresh)) | none


def _chosen(vectors: np.ndarray, nodes: np.ndarray, scores: np.ndarray, degree: int) -> np.ndarray:
    """[many, degree]: of the candidates of many nodes (by falling score, -1: none) the diverse ones first, then the nearest others."""
    many, width = nodes.shape
    degree_out = np.full((many, degree), -1, dtype=np.int64)
    if not many:
        return degree_out
    own = vectors[np.maximum(nodes, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    valid = nodes >= 0
    blocked = np.zeros((many, width), dtype=bool)
    picked = np.zeros((many, width), dtype=bool)
    for c in range(width):
        good = valid[:, c] & ~blocked[:, c] & (picked.sum(axis=1) < degree)
        picked[:, c] = good
        # Whoever is nearer to this neighbour than to the node itself.
        blocked |= good[:, None] & (between[:, c] > scores)
    rank = np.where(picked, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    kept = np.take_along_axis(np.where(valid, nodes, -1), order, axis=1)
    degree_out[:, : kept.shape[1]] = kept
    return degree_out


def _link(graph: Graph, level: int, nodes: np.ndarray, targets: np.ndarray) -> None:
    """Give ``nodes`` their chosen neighbours, and those a way back; where that is too many, they choose anew."""
    neighbours = graph.neighbours[level]
    neighbours[nodes, : targets.shape[1]] = targets
    a, b = np.nonzero(targets >= 0)
    back, new = targets[a, b], nodes[a]
    order = np.argsort(back, kind="stable")
    back, new = back[order], new[order]
    hit, first, many = np.unique(back, return_index=True, return_counts=True)
    degree = neighbours.shape[1]
    # Nodes with about as many new ways back at a time, so that no padding outweighs them.
    for low in 2 ** np.arange(0, 2 + int(np.log2(many.max(initial=1)))):
        group = np.flatnonzero((many >= low) & (many < 2 * low))
        chunk = max(1, 2**21 // (degree + 2 * low) ** 2)
        for begin in range(0, len(group), chunk):
            own = group[begin : begin + chunk]
            spot = np.arange(2 * low)[None, :]
            more = np.where(spot < many[own, None], new[np.minimum(first[own, None] + spot, len(new) - 1)], -1)
            every = np.concatenate([neighbours[hit[own]], more], axis=1)
            every = np.sort(every, axis=1)
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            value = np.einsum("ijk,ik->ij", graph.vectors[np.maximum(every, 0)], graph.vectors[hit[own]])
            value = np.where(every >= 0, value, -np.inf)
            order = np.argsort(-value, axis=1, kind="stable")
            every, value = np.take_along_axis(every, order, axis=1), np.take_along_axis(value, order, axis=1)
            crowded = (every >= 0).sum(axis=1) > degree
            kept = every[:, :degree].copy()
            kept[crowded] = _chosen(graph.vectors, every[crowded], value[crowded], degree)
            neighbours[hit[own]] = kept


def levels_of(n: int) -> np.ndarray:
    """Level of each of ``n`` nodes, falling; drawn from the numbers alone, so that every run builds the same graph."""
    draw = (arrays.mix(np.arange(n, dtype=np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(np.float64) + 0.5
    return np.sort(np.floor(-np.log(draw / 2**53) / np.log(M)).astype(np.int64))[::-1]


def build(vectors: np.ndarray) -> Graph:
    """The graph over ``vectors`` [nodes, dims], which all have one length."""
    n = len(vectors)
    level = levels_of(n)
    top = int(level.max(initial=0))
    sizes = [int((level >= l).sum()) for l in range(top + 1)]
    neighbours = [np.full((sizes[l], M if l else 2 * M), -1, dtype=np.int64) for l in range(top + 1)]
    graph = Graph(vectors, sizes, neighbours)
    done = min(n, 1)
    while done < n:
        # As many as are there already at most: nodes of one batch know each other by comparing all.
        own = int(level[done])
        end = min(sizes[own], done + min(TOGETHER, done))
        batch = np.arange(done, end)
        queries = vectors[batch]
        entries = np.zeros((len(batch), 1), dtype=np.int64)
        for l in range(top, -1, -1):
            upto = min(done, sizes[l])
            width = min(BUILD_BEAM, upto) if l <= own else min(EXPANDED, upto)
            found, scores = beam(graph, l, queries, entries, width, upto)
            entries = found[:, :EXPANDED]
            if l > own:
                continue
            each = queries @ queries.T
            np.fill_diagonal(each, -np.inf)
            others = np.where(np.isinf(each), -1, batch[None, :])
            nodes, values = np.concatenate([found, others], axis=1), np.concatenate([scores, each], axis=1)
            order = np.argsort(-values, axis=1, kind="stable")[:, :BUILD_BEAM]
            nodes, values = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(values, order, axis=1)
            _link(graph, l, batch, _chosen(vectors, nodes, values, M))
        done = end
    return graph


def search(graph: Graph, queries: np.ndarray, width: int) -> np.ndarray:
    """[queries, width]: numbers of the nodes found for each query, best first; -1 where there are fewer."""
    out = np.full((len(queries), width), -1, dtype=np.int64)
    n = graph.sizes[0]
    together = max(1, min(TOGETHER, 2**25 // n))
    for begin in range(0, len(queries), together):
        part = queries[begin : begin + together]
        entries = np.zeros((len(part), 1), dtype=np.int64)
        for l in range(len(graph.sizes) - 1, -1, -1):
            wide = min(width, n) if l == 0 else min(EXPANDED, graph.sizes[l])
            entries, _ = beam(graph, l, part, entries, wide, graph.sizes[l])
        out[begin : begin + len(part), : entries.shape[1]] = entries
    return out


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by the greatest length, with one more coordinate that makes all lengths one."""
    # Squares of tiny or huge entries leave the range of doubles; the largest entry sets the scale first.
    scaled = vectors / np.abs(vectors).max()
    lengths = np.einsum("ij,ij->i", scaled, scaled)
    most = lengths.max()
    more = np.sqrt(np.maximum(0.0, 1.0 - lengths / most))
    return np.column_stack([scaled / np.sqrt(most), more]).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, values array<double>) of the vectors that take part, each distinct row once."""
    values = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    infinity = F.lit(float("inf"))
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity))
    # A negative zero is a zero, also to groupings.
    plain = F.transform("values", lambda x: x + F.lit(0.0))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("values"))
    found = found.where(F.col("vec_id").isNotNull() & finite & F.exists("values", lambda x: x != 0))
    return found.select("vec_id", plain.alias("values")).distinct()


SHARD = "shard int, dims int, sizes array<int>, neighbours binary, vectors binary, first binary, ids binary"


def _built(rows: pa.Table) -> pa.Table:
    """One shard from its rows (shard, dims, values, ids): the nodes by content, so that the graph depends on nothing else."""
    dims = rows.column("dims")[0].as_py()
    vectors = rows.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    lists = rows.column("ids").to_pylist()
    order = np.argsort([min(x) for x in lists], kind="stable")
    vectors, lists = np.ascontiguousarray(vectors[order]), [sorted(lists[k]) for k in order]
    graph = build(lifted(vectors))
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids = np.array([i for x in lists for i in x], dtype=np.int64)
    flat = np.concatenate([x.ravel() for x in graph.neighbours]).astype(np.int32)
    row = {
        "shard": rows.column("shard")[0].as_py(), "dims": dims, "sizes": graph.sizes, "neighbours": flat.tobytes(),
        "vectors": vectors.tobytes(), "first": first.tobytes(), "ids": ids.tobytes(),
    }
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 4]
    return pa.Table.from_pydict({k: pa.array([v], t) for (k, v), t in zip(row.items(), kinds, strict=True)})


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard, stored: what :func:`nearest` searches. ``vectors`` as :func:`usable` returns them.

    A shard holds vectors of one number of dimensions and of similar lengths:
    beside a vector a million times as long, others could not be told apart.
    """
    order = Window.partitionBy("values").orderBy("vec_id")
    kept = vectors.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1)
    nodes = kept.groupBy("values").agg(F.collect_list("vec_id").alias("ids"))
    nodes = written(nodes.select("*", F.size("values").alias("dims"), _band().alias("band")), "ann-nodes")
    dealt, base = [], 0
    for r in nodes.groupBy("dims", "band").count().orderBy("dims", "band").collect():  # a few kinds of vectors
        many = max(1, -(-r["count"] // shard_rows))
        dealt.append((r.dims, r.band, base, many))
        base += many
    plan = nodes.sparkSession.createDataFrame(dealt, "dims int, band int, base int, many int")
    shard = F.col("base") + F.pmod(F.xxhash64("values"), F.col("many")).cast("int")
    placed = nodes.join(plan, ["dims", "band"]).select(shard.alias("shard"), "dims", "values", "ids")
    return written(placed.groupBy("shard").applyInArrow(_built, SHARD), "ann-shards")


def _band() -> Column:
    """Lengths of one band are within a factor of four (and lengths about 1 in one band)."""
    largest = F.array_max(F.transform("values", lambda x: F.abs(x)))
    squares = F.aggregate("values", F.lit(0.0), lambda total, x: total + (x / largest) * (x / largest))
    return F.floor((F.log2(largest) + F.log2(squares) / 2) / 2 + 0.5).cast("int")


def read_shard(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, vectors, where each node's ids begin, ids) of a stored shard."""
    vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, row["dims"])
    flat = np.frombuffer(row["neighbours"], dtype=np.int32).astype(np.int64)
    neighbours, at = [], 0
    for level, size in enumerate(row["sizes"]):
        degree = M if level else 2 * M
        neighbours.append(flat[at : at + size * degree].reshape(size, degree))
        at += size * degree
    graph = Graph(lifted(vectors), row["sizes"], neighbours)
    return graph, vectors, np.frombuffer(row["first"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)


FOUND = "query_id long, vec_id long, score double"


def nearest(stored: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the ``k`` vectors found with the largest inner product, its own id left out.

    ``stored`` is an :func:`index` made for this ``k``, ``queries`` are as
    :func:`usable` returns them. Scores are exact inner products of the
    original vectors; ties go to the smaller vec_id; with fewer vectors all
    come. Rows of one id with different vectors are candidates and queries of
    their own; a candidate is listed once, by its best score. Queries only meet
    vectors of as many dimensions. Nothing comes of an empty table.
    """
    shards = {}
    for r in stored.select("shard", "dims").collect():  # one row per SHARD_ROWS vectors
        shards.setdefault(r.dims, []).append(r.shard)
    if not shards:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = max(1, -(-queries.count() // PART_QUERIES))
    visited = stored.select("shard", "dims").groupBy("dims").agg(F.collect_list("shard").alias("shards"))
    dealt = queries.withColumn("dims", F.size("values")).join(visited, "dims")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", "values"), F.lit(parts)).cast("int"))
    dealt = dealt.select(F.explode("shards").alias("shard"), "part", "vec_id", "values")
    copies = stored.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def answer(_: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(shard) or not len(asked):
            return _rows([], [], [])
        graph, vectors, first, ids = read_shard(shard.to_pylist()[0])
        asked_ids = asked.column("vec_id").to_numpy()
        own = asked.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
        steering = own / np.abs(own).max(axis=1, keepdims=True)
        steering = np.column_stack([steering, np.zeros(len(own))]).astype(np.float32)
        out = []
        # One node goes to the query itself.
        for begin in range(0, len(own), TOGETHER):
            part = slice(begin, begin + TOGETHER)
            nodes = search(graph, steering[part], max(width, k + 1))
            q, c = np.nonzero(nodes >= 0)
            node = nodes[q, c]
            score = (own[part][q] * vectors[node]).sum(axis=1)
            many = first[node + 1] - first[node]
            spread = np.repeat(np.arange(len(node)), many)
            vec = ids[np.arange(len(spread)) - np.repeat(np.cumsum(many) - many, many) + first[node][spread]]
            q, score = q[spread], score[spread]
            other = asked_ids[part][q] != vec
            q, vec, score = q[other], vec[other], score[other]
            order = np.lexsort((vec, -score, q))
            q, vec, score = q[order], vec[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            # Of a repeated id the best score counts, so a few more than k may come.
            good = rank < k * (1 + _repeats(ids))
            out.append((asked_ids[part][q[good]], vec[good], score[good]))
        return _rows(*map(np.concatenate, zip(*out, strict=True)))

    found = copies.groupBy("shard", "part").cogroup(dealt.groupBy("shard", "part")).applyInArrow(answer, FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _repeats(ids: np.ndarray) -> int:
    """How often an id stands behind other vectors of the shard as well, at most."""
    return int(np.unique(ids, return_counts=True)[1].max(initial=1)) - 1


def _rows(queries, vectors, scores) -> pa.Table:
    columns = [pa.array(queries, pa.int64()), pa.array(vectors, pa.int64()), pa.array(scores, pa.float64())]
    return pa.Table.from_arrays(columns, ["query_id", "vec_id", "score"])
