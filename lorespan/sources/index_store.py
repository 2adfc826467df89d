"""The index on disk: relations as versioned Parquet folders under one root.

A refresh writes only the rows of re-indexed files, as a new version, and a manifest that names each file put or deleted. Every run of a version writes into folders of its
own and ends with one row in ``runs``, so readers see all of a run or nothing of it; of several runs of a version
the last counts. A row is live unless a later version puts or deletes its file. ``compact`` rewrites the live rows
as a base: readers skip the versions before it, ``vacuum`` deletes their folders.

What searches and lookups read is kept in the same way and never rebuilt: postings by token, the vocabulary, calls in
folders by a hash of the name they are asked for, and totals. Rows are not shuffled for that: each task sorts what it reads,
a bounded stretch, and writes it as a segment of its own, so a run moves little more than it writes. A version's totals are what its files add less
what the versions before had counted for them, so the totals of all versions add up to those of the live rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import text
from lorespan.operators import search
from lorespan.operators.lifecycle import stale_files
from lorespan.session import scans_of

RELATIONS = {
    "symbols": "name string, kind string, file string, start_line int, end_line int, signature string, language string, no int",
    "call_lines": "file string, line int, context string, refs array<struct<name: string, full_name: string>>",
    "imports": "symbol_name string, file string, import_line string",
}
_COLUMNS = {
    "symbols": ("name", "kind", "file", "start_line", "end_line", "signature", "language", "no"),
    "call_lines": ("file", "line", "context", "refs"),
    "imports": ("symbol_name", "file", "import_line"),
}
_POSTED = "col int, pos int, tok string"
#: What is stored for each relation, and what is made from the relations.
STORED = {
    "symbols": f"{RELATIONS['symbols']}, dl int",
    "call_lines": "file string, line int, context string, refs array<struct<name: string, full_name: string, same: boolean>>, dl int, own array<int>",
    "imports": RELATIONS["imports"],
    "named_calls": "symbol_name string, file string, line int, no int, bucket int",
    "symbol_postings": f"file string, no int, dl int, {_POSTED}",
    "line_postings": f"file string, line int, {_POSTED}",
    "name_postings": f"file string, line int, no int, {_POSTED}",
    "vocabulary": "tok string",
    "totals": ", ".join(f"{c} bigint" for c in search.TOTALS),
}
_TOTALS = ", ".join(f"{c} bigint" for c in search.TOTALS)
MANIFEST = f"file string, content_hash string, last_indexed double, language string, line_count int, {_TOTALS}, live boolean"
RUNS = "version bigint, run string, base boolean"
#: Folders that calls are dealt to by name.
BUCKETS = 64
#: Stored bytes of definitions or call lines whose postings or names a task sorts, in memory, as one segment.
#: Row groups are the least that a task can read of a file, so those of these two relations are small.
SEGMENTS = {"symbol_postings": 8 << 20, "line_postings": 10 << 20, "name_postings": 10 << 20, "named_calls": 20 << 20}
ROW_GROUP = 8 << 20
#: Level 9 takes a quarter more of a build's CPU time than level 4, for a few hundredths of its size.
ZSTD_LEVEL = 3


def name_bucket(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def by_name(rows: DataFrame) -> DataFrame:
    """Rows with the folder of their ``symbol_name``, laid out by folder within each task. In a folder they keep the order
    of files and lines: numbers are sorted many times faster than names, and files and lines take less room so."""
    return rows.withColumn("bucket", name_bucket(F.col("symbol_name"))).sortWithinPartitions("bucket")


def _packed(lines: DataFrame) -> DataFrame:
    """Call lines as they are stored: a full name that is the name itself is not written twice."""
    def one(r: Column) -> Column:
        same = r["name"].eqNullSafe(r["full_name"])
        return F.when(r.isNotNull(), F.struct(r["name"].alias("name"), F.when(~same, r["full_name"]).alias("full_name"), same.alias("same")))

    return lines.withColumn("refs", F.transform("refs", one))


def _unpacked(lines: DataFrame) -> DataFrame:
    def one(r: Column) -> Column:
        full = F.when(r["same"], r["name"]).otherwise(r["full_name"])
        return F.when(r.isNotNull(), F.struct(r["name"].alias("name"), full.alias("full_name")))

    return lines.withColumn("refs", F.transform("refs", one))


@dataclass(frozen=True)
class IndexStore:
    spark: SparkSession
    root: str

    def _path(self, name: str, version: int, run: str) -> str:
        return f"{self.root}/{name}/version={version}/run={run}"

    def _write(self, df: DataFrame, name: str, version: int, run: str) -> DataFrame:
        schema = {**STORED, "manifest": MANIFEST}[name]
        out = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", ZSTD_LEVEL)
        out = out.partitionBy("bucket") if "bucket" in df.columns else out
        out = out.option("parquet.block.size", ROW_GROUP) if name in ("symbols", "call_lines") else out
        out.parquet(self._path(name, version, run))
        return self.spark.read.schema(schema).parquet(self._path(name, version, run))

    def _read(self, name: str, schema: str, runs: list[tuple[int, str]]) -> DataFrame:
        schema = f"{schema}, version bigint, run string"
        if not runs:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}")
        return rows.parquet(*(self._path(name, *run) for run in runs))

    def _ended(self) -> list[tuple[int, str, bool]]:
        """All runs that ended: a row per refresh. Their names sort by time."""
        return sorted(map(tuple, self.spark.read.schema(RUNS).parquet(f"{self.root}/runs").collect()))

    def base(self) -> int:
        """The version that readers begin at."""
        return max((version for version, _, base in self._ended() if base), default=0)

    def _runs(self, before: int | None = None) -> list[tuple[int, str]]:
        """The run that counts of each version from the base on."""
        ended = self._ended()
        base = max((version for version, _, is_base in ended if is_base), default=0)
        last = {version: run for version, run, _ in ended if version >= base and (before is None or version < before)}
        return sorted(last.items())

    def _end(self, version: int, run: str, base: bool = False) -> None:
        self.spark.createDataFrame([(version, run, base)], RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    def create(self) -> IndexStore:
        """An index without any version."""
        self.spark.createDataFrame([], RUNS).write.parquet(f"{self.root}/runs")
        return self

    def write_version(self, version: int, files: DataFrame, deleted: DataFrame, relations: dict[str, DataFrame]) -> None:
        """``files`` are the meta rows of re-indexed files, ``deleted`` has the column file. Texts are extracted once;
        postings, names and totals are made from what was written."""
        before = self._latest(version).select("file", *search.TOTALS)
        self._put(version, files, deleted, relations, before)

    def _put(self, version: int, files: DataFrame, deleted: DataFrame, relations: dict[str, DataFrame], before: DataFrame | None) -> None:
        run = _run()
        rows = {name: df.select(*_COLUMNS[name]) for name, df in relations.items()}
        symbols = self._write(search.measured_symbols(rows["symbols"]), "symbols", version, run)
        lines = self._write(_packed(search.measured_lines(rows["call_lines"])), "call_lines", version, run)
        self._write(rows["imports"], "imports", version, run)
        calls = text.unfold(lines, ["file", "line"], F.col("refs")["name"], "no", "symbol_name")
        # a segment is a file in every folder, so a small index has one segment
        with scans_of(self.spark, SEGMENTS["named_calls"], least=1):
            self._write(by_name(calls.select("symbol_name", "file", "line", "no")), "named_calls", version, run)
        posted = []
        for name, df in search.postings(symbols, lines).items():
            with scans_of(self.spark, SEGMENTS[name]):
                posted.append(self._write(search.by_token(df), name, version, run))
        self._write(search.vocabulary(posted).sortWithinPartitions("tok"), "vocabulary", version, run)
        lengths = search.summed(search.row_lengths(symbols, lines), "file")
        nothing = {c: F.lit(None).cast(t) for c, t in (("content_hash", "string"), ("last_indexed", "double"), ("language", "string"), ("line_count", "int"))}
        gone = deleted.select("file").distinct().withColumns(nothing | {c: F.lit(0).cast("bigint") for c in search.TOTALS} | {"live": F.lit(False)})
        put = files.join(lengths, "file", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in search.TOTALS} | {"live": F.lit(True)})
        told = put.select(*gone.columns).unionByName(gone)
        told = self._write(told, "manifest", version, run)
        added = told.select("file", *search.TOTALS)
        if before is not None:
            left = before.join(told.select("file"), "file", "left_semi").select("file", *[(-F.col(c)).alias(c) for c in search.TOTALS])
            added = added.unionByName(left)
        self._write(search.summed(added), "totals", version, run)
        self._end(version, run, base=before is None)

    def _latest(self, before: int | None = None) -> DataFrame:
        rows = self._read("manifest", MANIFEST, self._runs(before))
        fields = [c for c in rows.columns if c not in ("file", "version")]
        return rows.groupBy("file").agg(F.max_by(F.struct("version", *fields), "version").alias("m")).select("file", "m.*").filter("live")

    def file_meta(self, before: int | None = None) -> DataFrame:
        """Live files, of all versions or of those before one."""
        return self._latest(before).drop("version", "run", "live", *search.TOTALS)

    def _live(self, name: str, runs: list[tuple[int, str]] | None = None) -> DataFrame:
        """Rows that no later version replaces. Only what was refreshed since the base is looked at for that."""
        runs = self._runs() if runs is None else runs
        rows = self._read(name, STORED[name], runs)
        later = runs[1:]
        if later:
            touched = self._read("manifest", MANIFEST, later).groupBy(F.col("file").alias("_file")).agg(F.max("version").alias("_last"))
            rows = rows.join(touched, (F.col("file") == F.col("_file")) & (F.col("version") < F.col("_last")), "left_anti")
        rows = rows.drop("version", "run")
        return _unpacked(rows) if name == "call_lines" else rows

    def relation(self, name: str) -> DataFrame:
        return self._live(name).select(*_COLUMNS[name])

    def relations(self) -> dict[str, DataFrame]:
        return {name: self.relation(name) for name in RELATIONS}

    def text_index(self) -> search.TextIndex:
        """What searches read. Tokens of replaced rows may still be in the vocabulary; no posting has them."""
        runs = self._runs()
        totals = search.summed(self._read("totals", STORED["totals"], runs))
        words = self._read("vocabulary", STORED["vocabulary"], runs).select("tok")
        live = {name: self._live(name, runs) for name in ("symbols", "call_lines", "symbol_postings", "line_postings", "name_postings")}
        return search.TextIndex(**live, vocabulary=words if len(runs) == 1 else words.distinct(), totals=totals)

    def calls(self, names: DataFrame | None = None) -> DataFrame:
        """``(symbol_name, file, line, no)`` of all calls; with ``names`` (symbol_name) only the folders of these are read."""
        rows = self._live("named_calls")
        if names is not None:
            # at most as many values as there are folders
            buckets = [r.bucket for r in names.select(name_bucket(F.col("symbol_name")).alias("bucket")).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(*buckets)) if buckets else rows.limit(0)
        return rows.drop("bucket")

    def imports(self, names: DataFrame | None = None) -> DataFrame:
        """The imports relation; with ``names`` (symbol_name) the rows of these. Rows lie by file, so those of a statement
        share its text, which is read only where it is asked for."""
        rows = self._live("imports")
        return rows if names is None else rows.join(names.select("symbol_name").distinct(), "symbol_name", "left_semi")

    def compact(self, version: int) -> None:
        """Writes the live rows as one version and lets readers begin there."""
        self._put(version, self.file_meta(), self.spark.createDataFrame([], "file string"), self.relations(), None)

    def vacuum(self) -> None:
        """Deletes the folders of versions before the base. No reader may still use an older base."""
        base = self.base()
        store, root = pafs.FileSystem.from_uri(self.root)
        for name in (*STORED, "manifest"):
            for folder in store.get_file_info(pafs.FileSelector(f"{root}/{name}")):
                if folder.base_name.startswith("version=") and int(folder.base_name[8:]) < base:
                    store.delete_dir(folder.path)


def _run() -> str:
    """A name for a run; later ones sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def refresh(store: IndexStore, corpus: DataFrame, gone: DataFrame, version: int,
            extract: dict[str, Callable[[DataFrame], DataFrame]], meta: Callable[[DataFrame], DataFrame],
            incremental: bool = True) -> None:
    """One index run: re-extracts the stale files of ``corpus`` (file, content, content_hash, language) and
    drops the files of ``gone``. A full run takes every file.

    The run compares with the versions before its own, so repeating it gives the same result. The list
    of stale files is written first: extraction then reads only those, and hashes nothing again.
    """
    known = store.file_meta(before=version)
    todo = corpus
    if incremental:
        listing = f"{store.root}/stale/version={version}"
        stale_files(corpus, known).select("file", "content_hash").write.mode("overwrite").parquet(listing)
        todo = corpus.drop("content_hash").join(store.spark.read.schema("file string, content_hash string").parquet(listing), "file")
    dropped = known.select("file").join(gone.select("file"), "file", "left_semi")
    store.write_version(version, meta(todo), dropped, {name: run(todo) for name, run in extract.items()})
