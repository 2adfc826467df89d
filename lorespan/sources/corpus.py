"""Corpus scan: which files are indexed, and what is known about each before it is parsed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import paths, text
from lorespan.session import scratch_dir

MAX_FILE_BYTES = 1_000_000
#: A batch of files read goes on at so many bytes or files.
BATCH_BYTES, BATCH_FILES = 16 << 20, 1000

# Directory names never entered.
IGNORED_DIRS = (
    ".git", "node_modules", "__pycache__", "venv", ".venv", "env", ".env", "dist", "build", ".mypy_cache",
    ".pytest_cache", ".ruff_cache", "target", ".idea", ".vscode",
)


def read_table(spark: SparkSession, path: str, parallelism: int | None = None) -> DataFrame:
    """A stored table of files. Spark cuts a scan at row groups; a table of few and large ones is dealt out anew to
    ``parallelism`` tasks, if asked for."""
    rows = spark.read.parquet(path)
    return rows if parallelism is None else rows.repartition(parallelism)


def list_tree(spark: SparkSession, root: str, extra_ignore=()) -> DataFrame:
    """``(file, size)`` of all files below a folder of any store that ``pyarrow.fs`` opens, whatever their names.

    Folders are listed level by level, each folder by the task it falls to, so a tree of one long branch is as
    many small jobs as it is deep and a wide one is spread. Ignored folders and those with a leading dot are not
    entered, nor are folders below the root that can't be listed. ``file`` is relative to ``root``.
    """
    skip = frozenset((*IGNORED_DIRS, *extra_ignore))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column("file").to_pylist():
                try:
                    found = store.get_file_info(pafs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/"), recursive=False))
                except OSError:
                    if not folder:
                        raise
                    continue
                kept = [x for x in found if x.type == pafs.FileType.File or x.type == pafs.FileType.Directory and not x.base_name.startswith(".") and x.base_name not in skip]
                names = [f"{folder}/{x.base_name}".lstrip("/") for x in kept]
                yield pa.record_batch(
                    [pa.array(names, pa.string()), pa.array([x.size for x in kept], pa.int64()), pa.array([x.type == pafs.FileType.Directory for x in kept], pa.bool_())],
                    names=["file", "size", "folder"],
                )

    level, parts = spark.createDataFrame([("",)], "file string"), []
    while not level.isEmpty():
        path = scratch_dir(spark, "listing")
        level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(listed, "file string, size long, folder boolean").write.parquet(path)
        parts.append(spark.read.schema("file string, size long, folder boolean").parquet(path))
        level = parts[-1].filter("folder").select("file")
    files = parts[0]
    for part in parts[1:]:
        files = files.union(part)
    return files.filter("not folder").select("file", "size")


def read_tree(spark: SparkSession, root: str, extra_ignore=(), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``(file, bytes, size, unreadable)`` of all files below a folder, read by tasks.

    Files over ``max_bytes`` are not read; one that can't be read is marked and the others go on.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        rows, held = [], 0

        def filled() -> pa.RecordBatch:
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.bool_())
            return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "bytes", "size", "unreadable"])

        for batch in batches:
            for file, size in zip(batch.column("file").to_pylist(), batch.column("size").to_pylist(), strict=True):
                data, failed = None, False
                if size <= max_bytes:
                    try:
                        with store.open_input_stream(f"{top.rstrip('/')}/{file}") as stream:
                            data = stream.read()
                    except OSError:
                        failed = True
                rows.append((file, data, size, failed))
                held += len(data or b"")
                if held >= BATCH_BYTES or len(rows) == BATCH_FILES:
                    yield filled()
                    rows, held = [], 0
        if rows:
            yield filled()

    return list_tree(spark, root, extra_ignore).repartition("file").mapInArrow(read, "file string, bytes binary, size long, unreadable boolean")


def ignore_names(lines: DataFrame, line: str = "value") -> DataFrame:
    """``name``: extra directory names from the lines of an ignore file, without blank and ``#`` lines."""
    name = F.regexp_replace(line, r"^\s+|\s+$", "")
    return lines.filter(~F.startswith(line, F.lit("#"))).select(name.alias("name")).filter("name <> ''").distinct()


def scan_corpus(files: DataFrame, language: Column | None = None, extra_ignore=(), max_bytes: int = MAX_FILE_BYTES,
                test_rules: Column | None = None) -> DataFrame:
    """Adds language, test flag and ``too_big``; drops other languages and ignored directories.

    Files over the size limit, or that could not be read, stay, flagged: run statistics count them as skipped. ``test_rules`` is the
    language whose test file names apply, by default that of the file.
    """
    lang = paths.language_of(F.col("file")) if language is None else language
    names = {*IGNORED_DIRS, *extra_ignore}
    unreadable = F.col("unreadable") if "unreadable" in files.columns else F.lit(False)
    return (
        files.filter(~paths.in_ignored_dir(F.col("file"), names))
        .withColumn("language", lang)
        .filter(F.col("language").isNotNull())
        .select(
            *[c for c in files.columns if c != "language"],
            "language",
            paths.is_test_file(F.col("file"), F.col("language") if test_rules is None else test_rules).alias("is_test"),
            ((F.col("size") > max_bytes) | unreadable).alias("too_big"),
        )
    )


def decode(scanned: DataFrame) -> DataFrame:
    """Indexable files with their hash (raw bytes) and text (bad UTF-8 replaced)."""
    return scanned.filter(~F.col("too_big")).select(
        "file",
        "language",
        "is_test",
        F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"),
        F.sha2("bytes", 256).alias("content_hash"),
    )


def file_meta(corpus: DataFrame, as_of: Column) -> DataFrame:
    return corpus.select(
        "file", "content_hash", as_of.alias("last_indexed"), "language",
        F.size(text.lines(F.col("content"))).alias("line_count"),
    )
