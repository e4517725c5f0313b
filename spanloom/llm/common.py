"""What the corpus operators share: tables, intermediate results, keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder all executors share, read back.

    Cuts the lineage: an executor lost later costs no recomputation of ``df``.
    """
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder; for small results in loops."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def row_key(text: str = "text") -> list[Column]:
    """Columns that tell documents apart even where doc_id is null or repeated.

    Rows that agree in doc_id and text agree in the key and are treated alike.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key_id"),
        F.xxhash64(F.col(text)).alias("key_hash"),
        F.octet_length(body).cast("long").alias("key_size"),
    ]


KEY = ["key_id", "key_hash", "key_size"]


def id_remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one column ``row``, beside the row key and ``more``: no name can clash. ``row.*`` unpacks it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_key(), *more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
