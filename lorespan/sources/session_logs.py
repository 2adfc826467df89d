"""Agent session logs: one JSON record per line, with content that is text or a list of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.session import stored


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (session, project, mtime, pos, raw) of all logs below a path; ``pos`` numbers a log's lines from 0.

    Spark reads a log in byte ranges, each by the task it falls to, and gives a line that crosses a range's end to the range
    it begins in. Lines are numbered within their range by where they stand in the task; the lines of the ranges before come
    from a running sum over one row per range. No line is moved.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("place"),
    )
    ranges = lines.groupBy("path", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    above = W.partitionBy("path").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(ranges.select("path", "range", (F.coalesce(F.sum("n").over(above), F.lit(0)) - F.col("first")).alias("shift")), "log_ranges")
    return lines.join(starts, ["path", "range"]).select(
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.jsonl$", "").alias("session"),
        F.element_at(F.split("path", "/"), -2).alias("project"),
        "mtime", (F.col("place") + F.col("shift")).alias("pos"), F.col("value").alias("raw"),
    )


def parse_records(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``rec`` (variant). Blank lines are dropped; bad lines too, or they raise when ``strict``."""
    lines = raw.filter(F.trim("raw") != "")
    parse = F.parse_json if strict else F.try_parse_json
    parsed = lines.withColumn("rec", parse(F.col("raw")))
    return parsed if strict else parsed.filter(F.col("rec").isNotNull())


def list_sessions(logs: DataFrame, project: str | None = None, limit: int = 30) -> DataFrame:
    """Newest logs of a table (session, project, mtime)."""
    rows = logs if project is None else logs.filter(F.col("project") == project)
    return rows.orderBy(F.desc("mtime"), F.desc("project"), F.desc("session")).limit(limit)


def latest_per_project(logs: DataFrame) -> DataFrame:
    return logs.groupBy("project").agg(F.max(F.struct("mtime", "session")).alias("m")).select(
        "project", F.col("m.session").alias("session"), F.col("m.mtime").alias("mtime")
    )


def text_field(rec: Column, path: str) -> Column:
    return F.try_variant_get(rec, path, "string")


def is_text(rec: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(rec, path, "variant")) == "STRING", F.lit(False))


def blocks(rec: Column) -> Column:
    """Content blocks, null when the content is not a list."""
    return F.try_variant_get(rec, "$.message.content", "array<variant>")


def truthy(rec: Column, path: str) -> Column:
    """Present and not null, false, zero or empty."""
    value = F.try_variant_get(rec, path, "variant")
    return ~F.coalesce(F.to_json(value), F.lit("null")).isin("null", "false", "0", "0.0", '""', "[]", "{}")
