"""A set of 64-bit hashes as a bit field of bounded size: may say yes wrongly, never no wrongly.

The field is built by an aggregation and is the only thing that travels to the
driver and the tasks; its size is fixed, or follows the number of hashes up to a limit. With more hashes
than it was meant for it lets more rows pass, which the exact join behind it
removes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23
"""log2 of the size in bits: 1 MB."""
BITS_PER_HASH = 16
MOST_BITS = 28
"""log2 of the bits of the largest field: 32 MB."""


def bits_for(many: int) -> int | None:
    """log2 of the bits that so many hashes want; None where they would fill half of the largest field."""
    if many * 2 > 2**MOST_BITS:
        return None
    return min(max(16, (many * BITS_PER_HASH - 1).bit_length()), MOST_BITS)


def build(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Two bits are set for each well-mixed hash: one by its lower, one by its upper half."""
    halves = [F.col(column), F.shiftrightunsigned(F.col(column), 32)]
    positions = F.array(*(h.bitwiseAND(F.lit(2**bits - 1)) for h in halves))
    bit: Column = F.col("at").bitwiseAND(F.lit(63)).cast("int")
    words = (
        hashes.select(F.explode(positions).alias("at"))
        .groupBy(F.shiftrightunsigned(F.col("at"), 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        .toArrow()
    )
    field = np.zeros(2 ** (bits - 6), dtype=np.int64)
    field[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return field.view(np.uint64)


def holds(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    last = np.uint64(len(field) * 64 - 1)
    out = np.ones(len(hashes), dtype=bool)
    for half in (hashes, hashes >> np.uint64(32)):
        at = half & last
        out &= (field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out
