"""Postings, vocabulary, totals and names of a refreshed index against a fresh one; what lookups read."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorespan.operators import prose, resolve, search
from lorespan.sources import corpus as corpus_source
from lorespan.sources import index_store
from lorespan.sources.index_store import RELATIONS, IndexStore, refresh

EXTRACT = {"symbols": prose.definitions, "call_lines": prose.call_lines, "imports": prose.imports}


def corpus(spark, files):
    rows = [(f, "en", t) for f, t in files.items()]
    return spark.createDataFrame(rows, "file string, language string, content string").withColumn("content_hash", F.sha2("content", 256))


def meta(df):
    return corpus_source.file_meta(df, F.lit(1.0))


def run(store, files, version, gone=(), incremental=True):
    names = store.spark.createDataFrame([(f,) for f in gone], "file string")
    refresh(store, corpus(store.spark, files), names, version, EXTRACT, meta, incremental)


def text_of(rng, n):
    return "".join(" ".join(rng.choice(["token", "tokens", "valid", "alpha", "beta_x", "401", "été"]) for _ in range(rng.randrange(0, 6))) + "\n" for _ in range(n))


def fresh(spark, files, path):
    store = IndexStore(spark, path).create()
    run(store, files, 1, incremental=False)
    return store


def hits(spark, store, query="tok été 401 beta_x"):
    found = search.search(store.text_index(), search.literal_terms(spark, query), limit=40)
    return sorted((r.file, r.name, r.start_line, r["rank"], r.place, r.call_context, r.call_line) for r in found.collect())


@pytest.fixture(scope="module")
def refreshed(spark, tmp_path_factory):
    """An index after two refreshes that change, add, empty and drop files, and the files there are in the end."""
    rng = random.Random(7)
    first = {f"d/{n}.txt": text_of(rng, 12) for n in range(12)}
    store = fresh(spark, first, str(tmp_path_factory.mktemp("refreshed") / "index"))
    second = {**first, "d/1.txt": text_of(rng, 9), "d/2.txt": "", "d/20.txt": text_of(rng, 5)}
    for f in ("d/5.txt", "d/6.txt"):
        second.pop(f)
    run(store, second, 2, gone=["d/5.txt", "d/6.txt"])
    third = {**second, "d/1.txt": "one token 401\n", "d/5.txt": text_of(rng, 4)}
    third.pop("d/7.txt")
    run(store, third, 3, gone=["d/7.txt"])
    run(store, third, 3, gone=["d/7.txt"])  # a repeated run replaces itself
    return store, third


def table(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def same_as_fresh(spark, store, files, path):
    new = fresh(spark, files, path)
    assert hits(spark, store) == hits(spark, new) != []
    old, now = store.text_index(), new.text_index()
    for name in ("symbols", "call_lines", "symbol_postings", "line_postings", "name_postings", "totals"):
        assert table(getattr(old, name)) == table(getattr(now, name)), name
    assert {r.tok for r in now.vocabulary.collect()} <= {r.tok for r in old.vocabulary.collect()}
    words = [r.tok for r in old.vocabulary.collect()]
    assert len(words) == len(set(words))
    assert table(store.calls()) == table(new.calls())
    assert table(store.imports()) == table(new.imports())


def test_refreshed_index_equals_a_fresh_one(spark, refreshed, tmp_path):
    store, files = refreshed
    same_as_fresh(spark, store, files, str(tmp_path / "fresh"))
    assert sorted(r.file for r in store.file_meta().collect()) == sorted(files)


def test_a_refresh_writes_only_its_files(spark, refreshed):
    store, _ = refreshed
    for name in ("symbol_postings", "line_postings", "name_postings", "symbols", "call_lines"):
        assert {r.file for r in spark.read.parquet(f"{store.root}/{name}/version=3").select("file").distinct().collect()} <= {"d/1.txt", "d/5.txt"}


def test_purged_files_have_no_postings(spark, refreshed):
    store, _ = refreshed
    index = store.text_index()
    for df in (index.symbol_postings, index.line_postings, index.name_postings, store.calls(), store.imports()):
        assert not {"d/6.txt", "d/7.txt", "d/2.txt"} & {r.file for r in df.select("file").distinct().collect()}


def test_totals_of_all_versions_add_up(spark, refreshed):
    store, _ = refreshed
    index = store.text_index()
    counted = search.summed(search.row_lengths(index.symbols, index.call_lines)).first()
    assert index.totals.first() == counted
    assert index.symbol_postings.count() == counted.symbol_tokens


def test_compacted_index_equals_a_fresh_one(spark, refreshed, tmp_path):
    other, files = refreshed
    store = fresh(spark, {**files, "d/1.txt": "old tokens\n", "d/x.txt": "gone"}, str(tmp_path / "index"))
    run(store, files, 2, gone=["d/x.txt"])
    store.compact(3)
    store.vacuum()
    assert hits(spark, store) == hits(spark, other) != []
    run(store, {"d/1.txt": "after compaction 401\n"}, 4)
    same_as_fresh(spark, store, {**files, "d/1.txt": "after compaction 401\n"}, str(tmp_path / "again"))


def test_empty_index(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create()
    assert hits(spark, store) == [] and store.calls().count() == store.imports().count() == store.file_meta().count() == 0
    run(store, {"a.txt": ""}, 1)
    assert hits(spark, store) == [] and [r.file for r in store.file_meta().collect()] == ["a.txt"]


def scans(df):
    """(folder, files read) of every file scan of a query that has run."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        elif kind == "FileSourceScanExec":
            out.append((plan.relation().location().rootPaths().head().toString(), plan.metrics().apply("numFiles").value()))
        children = plan.children()
        todo += [children.apply(n) for n in range(children.size())]
    return out


def test_callers_read_the_folders_of_their_names(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(400)]
    files = {f"{n}.txt": "".join(f"w{rng.randrange(400)} {rng.choice(words)} hot\n" for _ in range(50)) for n in range(40)}
    store = fresh(spark, files, str(tmp_path / "index"))
    requests = spark.createDataFrame([(0, "w7"), (1, "w9"), (2, "none")], "request_id bigint, name string")
    defs = resolve.definitions(requests, store.relation("symbols"))
    names = resolve.asked_names(defs)
    whole = table(resolve.callers(defs, store.relation("call_lines")))
    sites = resolve.callers(defs, store.calls(names))
    assert table(sites) == whole != []
    assert table(resolve.importers(defs, store.imports(names))) == table(resolve.importers(defs, store.imports()))
    read = sum(n for folder, n in scans(store.calls(names)) if "named_calls" in folder)
    every = sum(n for folder, n in scans(store.calls()) if "named_calls" in folder)
    assert 0 < read <= 4 < index_store.BUCKETS // 2 <= every
    nobody = resolve.asked_names(defs.filter("false"))
    assert store.calls(nobody).count() == store.imports(nobody).count() == 0


def test_a_search_reads_few_scans(spark, refreshed):
    store, _ = refreshed
    found = search.search(fresh_view(store), search.literal_terms(spark, "tok 401"))
    of_index = [folder.rsplit("/", 1)[1] for folder, _ in scans(found) if "-compact/" in folder]
    assert len(of_index) < 10 and of_index.count("symbol_postings") == 1 and "line_postings" not in of_index


def fresh_view(store):
    """The index as of its last compaction has no refreshes to look through."""
    path = f"{store.root}-compact"
    index = store.text_index()
    return search.TextIndex.build(store.spark, index.symbols.drop("dl"), index.call_lines.drop("dl", "own"), path)


def test_many_spans_and_calls_of_one_file(spark):
    spans = spark.range(20_000).select(F.format_string("test%d", "id").alias("name"), F.lit("function").alias("kind"), F.lit("test_x.py").alias("file"),
        (F.col("id") * 5 + 1).cast("int").alias("start_line"), (F.col("id") * 5 + 4).cast("int").alias("end_line"), F.lit("").alias("signature"), F.lit("python").alias("language"), F.col("id").cast("int").alias("no"))
    whole = spark.createDataFrame([("TestAll", "class", "test_x.py", 1, 100_000, "", "python", 20_000)], RELATIONS["symbols"])
    sites = spark.range(100_000).select(F.lit(0).cast("bigint").alias("request_id"), F.lit("test_x.py").alias("file"), (F.col("id") + 1).cast("int").alias("line"), F.lit(0).alias("no"))
    start = time.perf_counter()
    found = resolve.with_enclosing_test(sites, spans.unionByName(whole), F.lit("python")).groupBy(F.col("enclosing_test") == "TestAll").count().collect()
    assert time.perf_counter() - start < 30
    assert {tuple(r) for r in found} == {(True, 20_000), (False, 80_000)}


def test_the_index_is_laid_out_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Each task sorts a bounded stretch of the rows and writes it as a segment of its own."""
    rng = random.Random(5)
    files = {f"{n}.txt": text_of(rng, 60) for n in range(30)}
    small = fresh(spark, files, str(tmp_path / "small"))
    index = small.text_index()
    for df in (search.by_token(index.line_postings), index_store.by_name(small.calls())):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(index_store, "SEGMENTS", dict.fromkeys(index_store.SEGMENTS, 2000))
    monkeypatch.setattr(index_store, "ROW_GROUP", 2000)
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    store = fresh(spark, files, str(tmp_path / "index"))
    assert spark.conf.get(size) == before
    segments = spark.read.parquet(f"{store.root}/symbol_postings").groupBy(F.input_file_name().alias("segment")).agg(F.count_if(F.col("tok") == "token").alias("n")).collect()
    assert len(segments) > 4 and all(r.n for r in segments)
    same_as_fresh(spark, store, files, str(tmp_path / "again"))


def test_imports_of_some_names(spark, refreshed):
    store, _ = refreshed
    names = spark.createDataFrame([("token",), ("none",), ("token",)], "symbol_name string")
    assert table(store.imports(names)) == table(store.imports().filter("symbol_name = 'token'")) != []


def test_a_full_name_is_not_written_twice(spark, tmp_path):
    """Full names that are the name itself are left out of the files and come back, beside others and nulls."""
    refs = [("f", "f"), ("join", "os.path.join"), ("g", None), (None, None), (None, "x.y")]
    lines = spark.createDataFrame([("a.py", 1, "f(os.path.join(g()))", refs), ("a.py", 2, "", []), ("b.py", 1, None, None)], RELATIONS["call_lines"])
    files = spark.createDataFrame([("a.py", "1"), ("b.py", "2")], "file string, content_hash string").selectExpr("*", "1.0D AS last_indexed", "'python' AS language", "2 AS line_count")
    store = IndexStore(spark, str(tmp_path / "index")).create()
    none = {name: spark.createDataFrame([], RELATIONS[name]) for name in ("symbols", "imports")}
    store.write_version(1, files, spark.createDataFrame([], "file string"), {"call_lines": lines, **none})
    assert table(store.relation("call_lines")) == table(lines)
    assert store.relation("call_lines").schema.simpleString() == lines.schema.simpleString()
    written = spark.read.parquet(f"{store.root}/call_lines").selectExpr("inline(refs)").filter("name = 'f' OR name IS NULL AND same")
    assert [r.full_name for r in written.collect()] == [None, None]
    store.compact(2)
    assert table(store.relation("call_lines")) == table(lines)


def test_postings_of_calls_hold_no_length(spark, refreshed):
    """Searches take it from the line of a call."""
    index = refreshed[0].text_index()
    assert "dl" in index.symbol_postings.columns and "dl" in index.call_lines.columns
    for name in ("line_postings", "name_postings"):
        assert "dl" not in spark.read.parquet(f"{refreshed[0].root}/{name}").columns and "dl" not in getattr(index, name).columns
