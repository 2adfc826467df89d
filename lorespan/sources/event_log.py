"""Event log as an append-only Parquet table, one folder per UTC day, run and attempt.

A run is known once its row stands in ``runs``; of several attempts of a run the last counts, for all its days. ``compact``
rewrites the days before a day as one run, so that many small runs leave few files.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run string, attempt long, until date"
#: The run that holds compacted days.
COMPACTED = ""


def append_events(events: DataFrame, path: str, run: str) -> None:
    """Appends the rows (id, event_type, ts, duration_ms, metadata) of a run; ``ts`` is UTC.

    A run that is appended again replaces all its own rows. Rows of a day are laid together before
    the write, in as many files as their size asks for: AQE splits a day that is larger than a partition.
    """
    if run == COMPACTED:
        raise ValueError("a run needs a name")
    _write(events.withColumn("date", F.to_date("ts")), path, run, None)


def _write(dated: DataFrame, path: str, run: str, until: str | None) -> None:
    attempt, spark = time.time_ns(), dated.sparkSession
    named = dated.withColumns({"run": F.lit(f"r{run}"), "attempt": F.lit(attempt)})
    named.hint("rebalance", "date").write.mode("append").partitionBy("date", "run", "attempt").parquet(f"{path}/events")
    ended = spark.range(1).select(F.lit(run).alias("run"), F.lit(attempt).alias("attempt"), F.lit(until).cast("date").alias("until"))
    ended.coalesce(1).write.mode("append").parquet(f"{path}/runs")


def _live(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last attempt of each run, with their day; compacted days come from the compaction alone."""
    runs = spark.read.schema(RUNS).parquet(f"{path}/runs")
    last = runs.groupBy("run").agg(F.max(F.struct("attempt", "until")).alias("m")).select(F.concat(F.lit("r"), "run").alias("run"), "m.attempt")
    until = runs.filter(F.col("run") == COMPACTED).agg(F.max(F.struct("attempt", "until")).alias("m")).select("m.until").first()[0]
    rows = spark.read.parquet(f"{path}/events").join(last, ["run", "attempt"], "left_semi")
    if until is None:
        return rows.drop("run", "attempt")
    return rows.filter((F.col("run") == f"r{COMPACTED}") | (F.col("date") >= F.lit(until))).drop("run", "attempt")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A filter on ``date`` reads only the folders of those days."""
    return _live(spark, path)


def compact(spark: SparkSession, path: str, before: str) -> None:
    """Rewrites all days before a day (yyyy-mm-dd), which must not lie before that of an earlier compaction. Runs that are
    appended again later change the days from that day on only."""
    _write(_live(spark, path).filter(F.col("date") < F.lit(before).cast("date")), path, COMPACTED, before)
