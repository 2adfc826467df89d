"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lorespan", cores: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benches; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.minPartitionNum", str(cores))
        .config("spark.sql.files.openCostInBytes", "128k")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    A local master without that setting gets a temporary folder; a cluster without it is an
    error, because other machines could not read what is written there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="lorespan-")
    return f"{base.rstrip('/')}/lorespan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared checkpoint folder and read again: computed once, and lost executors lose nothing."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scans_of(spark: SparkSession, most: int, least: int | None = None) -> Iterator[None]:
    """Within it, a task of a file scan reads at most so many bytes of files, however many a session lets it read; with
    ``least`` so many tasks are enough."""
    wanted = {"spark.sql.files.maxPartitionBytes": most, "spark.sql.files.minPartitionNum": least}
    before = {name: spark.conf.get(name, None) for name, value in wanted.items() if value is not None}
    for name in before:
        spark.conf.set(name, str(wanted[name]))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
