"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Every window of three consecutive lines is hashed. A window that occurs more
than once is kept where it occurs first, by doc_id and then by place; at its
later occurrences, in other documents or further down in the same one, all its
lines go. Overlapping later windows are merged by their positions, so a passage
of any length goes as a whole, while its first occurrence stays.

Only hashes, ids and positions are shuffled for the search. The first
occurrence is an aggregation that combines before the shuffle; occurrences are
told from it by a join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import KEY, row_key, written

LINES = 3
BLANK = " \t\r"
"""Windows of such characters only are no passage."""


def repeated_positions(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(key, covered array<int>): positions of the lines inside later occurrences of windows."""
    texts = docs.select(*row_key(), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= lines)
    starts = F.sequence(F.lit(0), F.size("lines") - lines)
    # Two hashes of 64 bits: windows of a very large corpus do not collide by chance.
    windows = F.transform(
        starts,
        lambda i: F.struct(
            i.cast("int").alias("at"),
            F.xxhash64(F.slice("lines", i + 1, lines)).alias("h1"),
            F.xxhash64(F.lit(1), F.slice("lines", i + 1, lines)).alias("h2"),
            (F.translate(F.array_join(F.slice("lines", i + 1, lines), ""), BLANK, "") != "").alias("visible"),
        ),
    )
    found = texts.select(*KEY, F.explode(windows).alias("w")).where("w.visible").select(*KEY, "w.at", "w.h1", "w.h2")
    place = F.struct("key_id", "key_hash", "key_size", "at")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first.select("h1", "h2", "first"), "repeated-windows")
    later = found.join(first, ["h1", "h2"]).where(place != F.col("first"))
    spots = later.groupBy(*KEY).agg(F.collect_set("at").alias("spots"))
    covered = F.flatten(F.transform("spots", lambda at: F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda k: at + k)))
    return spots.select(*KEY, F.array_distinct(covered).alias("covered"))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with the deduplicated ``text``, ``n_lines`` before and ``n_removed``.

    Lines end at a line feed. A text of fewer lines than a window keeps them
    all, null stays null with no line, an empty text is one empty line. A text
    all of whose lines go becomes empty. Rows that agree in doc_id and text are
    one document and are treated alike; a null doc_id comes before any other, and
    rows of one doc_id with different texts are ordered by a hash of the text.
    Other columns stay as they are; columns named n_lines and n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    covered = repeated_positions(docs.select("doc_id", "text"), lines)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    split = docs.select(others, *row_key(), F.split("text", "\n", -1).alias("lines"))
    joined = split.join(covered, KEY, "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(every, "covered"), lambda i: F.get("lines", i))
    text = F.array_join(F.when(F.col("covered").isNull(), F.col("lines")).otherwise(kept), "\n")
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
    )
