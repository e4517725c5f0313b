"""Exact top-k search by inner product, with a uniform threshold in three phases.

A score is the sum of partial scores over a few blocks of dimensions; each block
with each pack of vectors is a local list.

1. Every local list gives its k best entries per query, resolved exactly. The
   k-th best of them is a score that k vectors are known to reach.
2. That cutoff travels with the query to all packs. A vector that reaches it has
   in some of the m blocks a partial score of at least cutoff / m, whatever the
   signs; only such entries are collected, and those dropped whose known partial
   scores, with just under cutoff / m for the others, cannot reach it.
3. What is left is resolved exactly, and the k best per query are the answer.

Queries are packed into blocks as vectors are into packs; every pack meets every
query block by an equi-join on the block's number, and one multiplication of two
small matrices does the work of a million pairs. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import written

PACK = 2048
"""Vectors in a pack."""
QUERY_BLOCK = 512
"""Queries in a block."""
LISTS = 4
"""Blocks of dimensions."""
EXACT = 2.0**53


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, values array<long>) of the vectors that take part: not null, not empty, all components finite."""
    values = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    # No longs beyond this are meant by a score that is one; NaN fails both comparisons below.
    finite = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("values"))
    found = found.where(F.col("vec_id").isNotNull() & F.col("values").isNotNull()).where((F.size("values") > 0) & finite)
    return found.select("vec_id", F.transform("values", lambda x: F.floor(x * scale)).alias("values"))


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """(dims, ids binary, matrix binary): up to ``size`` vectors of as many dimensions, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            dims = lists.value_lengths().to_numpy()
            out = []
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                for begin in range(0, len(own), size):
                    part = own[begin : begin + size]
                    out.append((int(d), ids[part].tobytes(), lists.take(pa.array(part)).flatten().to_numpy().tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["dims", "ids", "matrix"]
            )

    return vectors.mapInArrow(run, "dims int, ids binary, matrix binary")


def _partials(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """[lists, queries, vectors] partial scores, exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    kind = np.float64 if bound < EXACT else np.int64
    blocks = np.array_split(np.arange(queries.shape[1]), LISTS)
    products = [queries[:, b].astype(kind) @ vectors[:, b].astype(kind).T for b in blocks]
    return np.stack(products).astype(np.int64)


def _pair(rows: pa.RecordBatch, i: int) -> tuple:
    at = {name: rows.column(rows.schema.get_field_index(name))[i] for name in rows.schema.names}
    dims = at["dims"].as_py()
    buffer = lambda name: np.frombuffer(at[name].as_buffer(), dtype=np.int64)
    return buffer("q_ids"), buffer("q_matrix").reshape(-1, dims), buffer("ids"), buffer("matrix").reshape(-1, dims)


def _found(queries: np.ndarray, vectors: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(queries), pa.array(vectors), pa.array(scores)], ["query_id", "vec_id", "score"]
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of the greatest score for every query.

    ``vectors`` and ``queries`` have vec_id and embedding; components become
    floor(``scale`` * x), a score is their inner product. Ties go to the smaller
    vec_id; a query's own vec_id is left out; with fewer vectors all come.
    Vectors that are null, empty or hold null or non-finite components, or have
    no id, take no part; only vectors of the query's dimensions are compared.
    Of rows with one id every distinct one is a candidate or query of its own,
    and a candidate is listed once, by its best score. Scores must fit a long.
    """
    packs = written(_packed(quantised(vectors, scale), PACK), "packs")
    blocks = _packed(quantised(queries, scale).repartition(1 + queries.count() // QUERY_BLOCK), QUERY_BLOCK)
    blocks = blocks.select(
        F.monotonically_increasing_id().alias("block"), "dims", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")
    )
    blocks = written(blocks, "query-blocks")
    spread = packs.join(blocks.groupBy("dims").agg(F.collect_list("block").alias("blocks")), "dims")
    spread = spread.select("dims", "ids", "matrix", F.explode("blocks").alias("block"))

    def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                q_ids, q, ids, v = _pair(rows, i)
                partial = _partials(q, v)
                total = partial.sum(axis=0)
                lists = np.where((q_ids[:, None] == ids[None, :])[None], np.iinfo(np.int64).min, partial)
                n = min(k + 1, len(ids))
                best = np.argpartition(lists, len(ids) - n, axis=2)[:, :, len(ids) - n :]
                hit = np.zeros(total.shape, dtype=bool)
                np.put_along_axis(hit, np.concatenate(list(best), axis=1), True, axis=1)
                hit &= q_ids[:, None] != ids[None, :]
                a, b = np.nonzero(hit)
                yield _found(q_ids[a], ids[b], total[a, b])

    schema = "query_id long, vec_id long, score long"
    lists = spread.join(blocks.drop("dims"), "block").mapInArrow(local_best, schema)
    seen = _ranked(lists, k)
    cutoffs = written(seen.where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff")), "cutoffs")

    ids = blocks.mapInArrow(_block_ids, "block long, place int, query_id long")
    least = np.iinfo(np.int64).min
    with_cutoff = ids.join(cutoffs, "query_id", "left").groupBy("block")
    with_cutoff = with_cutoff.agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("cutoff", F.lit(least)).alias("cutoff")))).alias("placed")
    ).select("block", F.transform("placed", lambda p: p["cutoff"]).alias("cutoffs"))
    informed = blocks.drop("dims").join(with_cutoff, "block")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(rows.schema.get_field_index("cutoffs"))
            for i in range(len(rows)):
                q_ids, q, ids, v = _pair(rows.drop_columns(["cutoffs"]), i)
                cutoff = column[i].values.to_numpy()[:, None]
                share = (cutoff + (LISTS - 1)) // LISTS  # rounded up
                partial = _partials(q, v)
                known = partial >= share[None]
                bound = np.where(known, partial, np.maximum(share, least + 1)[None] - 1).astype(np.float64).sum(axis=0)
                hit = known.any(axis=0) & (bound >= cutoff - 1024.0) & (q_ids[:, None] != ids[None, :])
                a, b = np.nonzero(hit)
                score = partial[:, a, b].sum(axis=0)
                good = score >= cutoff[a, 0]
                yield _found(q_ids[a[good]], ids[b[good]], score[good])

    found = spread.join(informed, "block").mapInArrow(collect, schema)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        blocks = rows.column(0).to_numpy()
        for i in range(len(rows)):
            ids = np.frombuffer(rows.column(rows.schema.get_field_index("q_ids"))[i].as_buffer(), dtype=np.int64)
            places = np.arange(len(ids), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), blocks[i])), pa.array(places), pa.array(ids)], ["block", "place", "query_id"]
            )
