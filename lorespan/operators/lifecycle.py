"""Keeping an index fresh: change detection by content hash, upsert, purge, run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs from the stored one."""
    known = stored.select("file", F.col("content_hash").alias("_stored"))
    return (
        current.join(known, "file", "left")
        .filter(F.col("_stored").isNull() | (F.col("_stored") != F.col("content_hash")))
        .drop("_stored")
    )


def classify_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """new / changed / unchanged / deleted for every file of either side.

    Hashes of both sides are united and grouped by file, which needs one shuffle of two short columns.
    """
    both = current.select("file", F.col("content_hash").alias("new_hash"), F.lit(None).cast("string").alias("old_hash")).unionByName(
        stored.select("file", F.lit(None).cast("string").alias("new_hash"), F.col("content_hash").alias("old_hash"))
    )
    merged = both.groupBy("file").agg(F.max("new_hash").alias("new_hash"), F.max("old_hash").alias("old_hash"))
    return merged.select(
        "file",
        F.when(F.col("old_hash").isNull(), F.lit("new"))
        .when(F.col("new_hash").isNull(), F.lit("deleted"))
        .when(F.col("new_hash") == F.col("old_hash"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
        .alias("change"),
    )


def purge(relation: DataFrame, existing: DataFrame, file: str = "file") -> DataFrame:
    """Rows of files that still exist. Existence counts, not whether a file would still be indexed."""
    return relation.join(existing.select(F.col("file").alias(file)), file, "left_semi")


def upsert(relation: DataFrame, reindexed: DataFrame, rows: DataFrame, file: str = "file") -> DataFrame:
    """Replaces all rows of the re-indexed files by the new ones."""
    kept = relation.join(reindexed.select(F.col("file").alias(file)), file, "left_anti")
    return kept.unionByName(rows)


def run_stats(scanned: DataFrame, stored: DataFrame, symbols: DataFrame, incremental: bool) -> DataFrame:
    """Counts of one run. ``scanned`` needs file, content_hash and too_big; ``symbols`` those of all files.

    A file that is too big is skipped; an incremental run also skips unchanged ones. Symbols are
    counted for files indexed in this run only.
    """
    known = stored.select("file", F.col("content_hash").alias("_stored"))
    fresh = F.col("_stored").isNotNull() & (F.col("_stored") == F.col("content_hash"))
    skip = F.col("too_big") | (fresh if incremental else F.lit(False))
    per_file = symbols.groupBy("file").agg(F.count("*").alias("n"))
    return (
        scanned.select("file", "content_hash", "too_big")
        .join(known, "file", "left")
        .select("file", skip.alias("skip"))
        .join(per_file, "file", "left")
        .agg(
            F.count_if(~F.col("skip")).alias("files_indexed"),
            F.count_if("skip").alias("files_skipped"),
            F.coalesce(F.sum(F.when(~F.col("skip"), F.col("n"))), F.lit(0)).cast("bigint").alias("symbols"),
        )
    )
