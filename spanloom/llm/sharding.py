"""Uniform shuffle into shards of equal row counts, in DataFrame functions only.

Rows are dealt to cells by a hash, and the cells' sizes counted. How many rows
each cell sends to each shard, in a uniformly random assignment with the given
shard sizes, follows a multivariate hypergeometric law; the matrix of these
numbers is drawn on the driver (cells times shards numbers, however many rows
there are). Each cell then permutes its rows and deals them out by its row of
the matrix, and each shard permutes what it gets. Shard sizes are exact: at most
one row apart.

The second permutation numbers rows inside buckets, ranges of a second hash, and
adds the sizes of the buckets before, so that no shard has to fit one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024
BUCKETS = 64
"""Ranges of the second hash per shard."""


def matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """[cells, shards]: rows each cell sends to each shard; rows sum to ``sizes``, columns differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    left = np.full(shards, total // shards, dtype=np.int64)
    left[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for cell, size in enumerate(sizes):
        wanted = size
        for shard in range(shards):
            others = int(left[shard + 1 :].sum())
            out[cell, shard] = _draw(rng, int(left[shard]), others, wanted)
            wanted -= int(out[cell, shard])
        left -= out[cell]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric: exact while fewer than 10**9 rows are left to deal, beyond that by its normal limit."""
    if not good or not n:
        return 0
    if not bad:
        return n
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # Its mean and variance, rounded and held to what is possible. Shard sizes are exact all the same.
    p = good / (good + bad)
    spread = np.sqrt(n * p * (1 - p) * (good + bad - n) / max(good + bad - 1, 1))
    return int(min(max(round(rng.normal(n * p, spread)), n - bad, 0), good, n))


def _hash(seed: int, row: Column) -> Column:
    return F.xxhash64(F.lit(seed), row)


def uniform_shards(df: DataFrame, shards: int, seed: int = 1, cells: int = CELLS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0, gapless, in the shard).

    The same rows and seed give the same result, however they are partitioned.
    All columns take part in the order, so rows alike in every column are
    interchangeable, and any tie is between such rows. Nulls and empty texts are
    values like others; an empty table gives an empty result. Columns of those
    two names are replaced.
    """
    df = df.drop("shard", "slot")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    hashed = df.select(row.alias("row"), F.pmod(_hash(seed, row), F.lit(cells)).alias("cell"), _hash(seed + 1, row).alias("first"))
    sizes = {r["cell"]: r["count"] for r in hashed.groupBy("cell").count().collect()}
    order = sorted(sizes)
    sent = matrix([sizes[c] for c in order], shards, seed)
    bounds = df.sparkSession.createDataFrame(
        [(int(c), np.cumsum(row).tolist()) for c, row in zip(order, sent, strict=True)], "cell long, bounds array<long>"
    )
    within = Window.partitionBy("cell").orderBy("first", "row")
    dealt = hashed.withColumn("rank", F.row_number().over(within))
    # At most ``cells`` rows of ``shards`` numbers.
    dealt = dealt.join(F.broadcast(bounds), "cell")
    shard = F.size(F.filter("bounds", lambda b: b < F.col("rank")))
    second = _hash(seed + 2, F.col("row"))
    # The hash's highest bits name its bucket: buckets are ranges of the hash, in order.
    bucket = F.shiftrightunsigned(second, 64 - int(np.log2(BUCKETS)))
    dealt = dealt.select("row", shard.alias("shard"), second.alias("second"), bucket.alias("bucket"))
    counted = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most ``shards`` times BUCKETS rows.
    before = dealt.groupBy("shard", "bucket").count()
    before = before.select("shard", "bucket", F.coalesce(F.sum("count").over(counted), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("second", "row")
    numbered = dealt.withColumn("place", F.row_number().over(inside))
    numbered = numbered.join(F.broadcast(before), ["shard", "bucket"])
    return numbered.select("row.*", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
