"""Past sessions with their vectors: insert, list, clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan import schemas

_COLUMNS = [c.split()[0] for c in schemas.SESSION_MEMORY.split(", ")]


def as_memory(digests: DataFrame, id_col: Column, embedding: str, as_of: Column, tokens_used: Column | None = None) -> DataFrame:
    """Rows to insert from session digests that have an embedding column."""
    return digests.select(
        id_col.cast("bigint").alias("id"),
        "task_text",
        F.col(embedding).cast("array<float>").alias("task_embedding"),
        F.col("files_read").alias("context_files"),
        F.col("symbols_resolved").alias("context_symbols"),
        (F.lit(None) if tokens_used is None else tokens_used).cast("bigint").alias("tokens_used"),
        F.lit("success").alias("outcome"),
        F.lit(1.0).alias("confidence"),
        as_of.cast("timestamp").alias("created_at"),
        "session_id",
    )


def insert(memory: DataFrame, path: str) -> None:
    memory.select(*_COLUMNS).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SESSION_MEMORY).parquet(path)


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], schemas.SESSION_MEMORY).write.mode("overwrite").parquet(path)
