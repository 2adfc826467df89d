"""The four flows that run as streams. Each equals its batch twin once the input is drained."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespan.sources.index_store import IndexStore, refresh

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def timeline(events: DataFrame, watermark: str = "1 day", index_events=("init", "update")) -> DataFrame:
    """Calls and savings per UTC day and tool. ``ts`` must be a timestamp; older rows than the watermark are dropped."""
    return (
        events.filter(~F.col("event_type").isin(*index_events))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("tool"))
        .agg(F.count("*").alias("call_count"), F.coalesce(F.sum(F.col("tokens_saved").cast("bigint")), F.lit(0)).alias("tokens_saved"))
        .select(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / 86400).cast("int")), "yyyy-MM-dd").alias("date"), "tool", "call_count", "tokens_saved")
    )


def running_savings(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session").agg(F.sum("saved").alias("session_saved"), F.count("*").alias("calls"))


READ_STATE = "hash string, turn bigint"


def read_states(reads: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Re-read state per (session, file) from (session, file, turn, hash); a null hash is a missing file.

    ``turn`` is a column because a key sees only its own file. Without reads for ``idle_ms`` the
    session is forgotten and its next read is a first one.
    """
    out = f"session {dict(reads.dtypes)['session']}, file string, turn bigint, state string, ref_turn bigint"
    mode = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        digest, at = state.get if state.exists else (None, None)
        # most keys have few reads, for which a list is many times faster than columns
        reads = sorted((row for batch in batches for row in zip(batch["turn"].tolist(), batch["hash"].tolist(), strict=True)), key=lambda row: (row[0] != row[0], row[0]))
        states, refs = [], []
        for turn, seen in reads:
            if seen is None or seen != seen:
                refs.append(None)
                states.append("missing")
                continue
            refs.append(at)
            states.append("full" if digest is None else "unchanged" if seen == digest else "changed")
            if seen != digest:
                # turn of the last read that brought other content
                digest, at = seen, int(turn)
        if digest is not None:
            state.update((digest, at))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(
            {"session": key[0], "file": key[1], "turn": [turn for turn, _ in reads], "state": states, "ref_turn": pd.array(refs, dtype="Int64")}
        )

    return reads.select("session", "file", "turn", "hash").groupBy("session", "file").applyInPandasWithState(step, out, READ_STATE, "append", mode)


def index_feed(store: IndexStore, first_version: int, extract: dict[str, Callable[[DataFrame], DataFrame]],
               meta: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch function for a feed (file, language, content); null content removes the file.

    The version follows from the batch id, so a batch that is run again replaces itself.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        present = batch.filter(F.col("content").isNotNull()).withColumn("content_hash", F.sha2("content", 256))
        refresh(store, present, batch.filter(F.col("content").isNull()).select("file"), first_version + batch_id, extract, meta)

    return apply


def _start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str):
    spark = stream.sparkSession
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        return (
            stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all available input with RocksDB state and waits for the end.

    A sink with a ``path`` gets an empty table there first, so that a stream without input has a readable result.
    """
    if path := getattr(sink, "path", None):
        stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    _start(stream, sink, checkpoint, mode).awaitTermination()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    write.path = path
    return write


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Result of an update-mode stream: the last version of each key."""
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", path).parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")
