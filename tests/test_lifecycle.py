"""Scan rules, change detection, the versioned index store and its refresh."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lorespan.functions import paths
from lorespan.operators import extract, lifecycle
from lorespan.sources import corpus as corpus_source
from lorespan.sources.index_store import IndexStore, refresh

EXTRACT = {"symbols": extract.definitions, "call_lines": extract.call_lines, "imports": extract.imports}


def meta(df):
    return corpus_source.file_meta(df, F.lit(1.0))


def test_scan_rules(spark, tmp_path):
    files = {
        "a.py": b"x = 1\n", "pkg/B.PY": b"y\n", "pkg/c.txt": b"no", "pkg/.hidden/d.py": b"", "node_modules/e.js": b"", "sub/gen/f.ts": b"",
        ".env.py": b"", "__init__.py": b"", "pkg/_x.py": b"x", "big.go": b"a" * 1_000_000, "bigger.go": b"a" * 1_000_001, "src/tests/g.rs": b"", "bad.py": b"caf\xe9\n",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    lines = spark.createDataFrame([("# comment",), (" gen ",), ("",), ("other",)], "value string")
    ignore = {r.name for r in corpus_source.ignore_names(lines).collect()}
    assert ignore == {"gen", "other"}
    scanned = corpus_source.scan_corpus(corpus_source.read_tree(spark, str(tmp_path), ignore), extra_ignore=ignore)
    got = {r.file: (r.language, r.is_test, r.too_big) for r in scanned.collect()}
    assert got == {
        "a.py": ("python", False, False), "pkg/B.PY": ("python", False, False), ".env.py": ("python", False, False),
        "big.go": ("go", False, False), "bigger.go": ("go", False, True), "src/tests/g.rs": ("rust", True, False),
        "bad.py": ("python", False, False), "__init__.py": ("python", False, False), "pkg/_x.py": ("python", False, False),
    }
    larger = corpus_source.scan_corpus(corpus_source.read_tree(spark, str(tmp_path), ignore, max_bytes=2_000_000), extra_ignore=ignore, max_bytes=2_000_000)
    assert corpus_source.decode(larger).filter("file = 'bigger.go'").first().content == "a" * 1_000_001
    text = {r.file: r for r in corpus_source.decode(scanned).collect()}
    assert "bigger.go" not in text and text["bad.py"].content == "caf�\n"
    assert text["a.py"].content_hash == hashlib.sha256(b"x = 1\n").hexdigest()


def test_unreadable_files_are_skipped(spark, tmp_path):
    (tmp_path / "deep/er/and/deeper").mkdir(parents=True)
    (tmp_path / "deep/er/and/deeper/a.py").write_bytes(b"x = 1\n")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere")
    found = {r.file: r.unreadable for r in corpus_source.read_tree(spark, f"file://{tmp_path}").collect()}
    assert found["deep/er/and/deeper/a.py"] is False and found.get("gone.py", True) is True
    files = spark.createDataFrame([("a.py", None, 3, True), ("b.py", b"y", 1, False)], "file string, bytes binary, size long, unreadable boolean")
    assert {r.file: r.too_big for r in corpus_source.scan_corpus(files).collect()} == {"a.py": True, "b.py": False}
    assert [r.file for r in corpus_source.decode(corpus_source.scan_corpus(files)).collect()] == ["b.py"]


@pytest.mark.parametrize(
    "file, language, expected",
    [
        ("a/test_x.py", "python", True), ("a/x_test.py", "python", True), ("a/testx.py", "python", False),
        ("a/x.test.ts", "javascript", True), ("a/x.spec.js", "javascript", True), ("__tests__/x.js", "javascript", True), ("a/test.js", "javascript", False),
        ("x_test.go", "go", True), ("tests/x.go", "go", False), ("tests/x.rs", "rust", True), ("a/mytests/x.rs", "rust", False),
        ("test_x.txt", "prose", False),
    ],
)
def test_test_files(spark, file, language, expected):
    assert spark.range(1).select(paths.is_test_file(F.lit(file), F.lit(language)).alias("t")).first().t is expected


@pytest.mark.parametrize("file, ext", [("a.py", ".py"), ("a.tar.GZ", ".gz"), (".bashrc", ""), ("x/.env.py", ".py"), ("noext", ""), ("a.b/c", ""), ("..py", "")])
def test_extension(spark, file, ext):
    assert spark.range(1).select(paths.extension(F.lit(file)).alias("e")).first().e == ext


def listing(spark, **hashes):
    return spark.createDataFrame(list(hashes.items()) or [], "file string, content_hash string")


def test_changes(spark):
    now, then = listing(spark, a="1", b="2", c="3"), listing(spark, b="2", c="x", d="4")
    assert {(r.file, r.change) for r in lifecycle.classify_changes(now, then).collect()} == {("a", "new"), ("b", "unchanged"), ("c", "changed"), ("d", "deleted")}
    assert {r.file for r in lifecycle.stale_files(now, then).collect()} == {"a", "c"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file string, v int")
    new = spark.createDataFrame([("a", 9)], "file string, v int")
    once = lifecycle.upsert(old, listing(spark, a=""), new)
    twice = lifecycle.upsert(once, listing(spark, a=""), new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 9), ("b", 3)]
    assert {r.file for r in lifecycle.purge(once, listing(spark, b="")).collect()} == {"b"}


def test_run_stats(spark):
    scanned = spark.createDataFrame([("a", "1", False), ("b", "2", False), ("c", "3", True)], "file string, content_hash string, too_big boolean")
    symbols = spark.createDataFrame([("a",), ("a",), ("b",)], "file string")
    then = listing(spark, b="2")
    assert tuple(lifecycle.run_stats(scanned, then, symbols, True).first()) == (1, 2, 2)
    assert tuple(lifecycle.run_stats(scanned, then, symbols, False).first()) == (2, 1, 3)


def corpus(spark, **files):
    rows = [(f.replace("__", "/") + ".py", "python", t) for f, t in files.items()]
    return spark.createDataFrame(rows, "file string, language string, content string").withColumn("content_hash", F.sha2("content", 256))


def names(store):
    return sorted((r.file, r.name) for r in store.relation("symbols").collect())


def test_store_refresh(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create()
    none = spark.createDataFrame([], "file string")
    refresh(store, corpus(spark, a="def f(): pass\n", b="def g(): f()\n"), none, 1, EXTRACT, meta)
    assert names(store) == [("a.py", "f"), ("b.py", "g")]
    second = corpus(spark, a="def f2(): pass\n", b="def g(): f()\n", c="")
    gone = spark.createDataFrame([("b.py",)], "file string")
    for _ in range(2):  # a repeated run replaces itself
        refresh(store, second, gone, 2, EXTRACT, meta)
        assert names(store) == [("a.py", "f2")]
    written = spark.read.parquet(f"{store.root}/symbols/version=2")
    assert {r.file for r in written.collect()} == {"a.py"}  # unchanged files are not written again
    assert sorted(r.file for r in store.file_meta().collect()) == ["a.py", "c.py"]
    store.compact(3)
    assert store.base() == 3
    store.vacuum()
    assert [p.name for p in (tmp_path / "index/symbols").glob("version=*")] == ["version=3"]
    assert names(store) == [("a.py", "f2")]
    assert store.relation("call_lines").count() == 0


def test_uncommitted_version_is_invisible(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create()
    refresh(store, corpus(spark, a="def f(): pass\n"), spark.createDataFrame([], "file string"), 1, EXTRACT, meta)
    # A run that stopped before its end leaves rows nobody sees.
    extract.definitions(corpus(spark, a="def broken(): pass\n")).write.parquet(f"{store.root}/symbols/version=2/run=x")
    assert names(store) == [("a.py", "f")]
