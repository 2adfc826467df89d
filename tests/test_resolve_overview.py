"""Name resolution and structural roll-ups on small relations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorespan.functions import paths
from lorespan.operators import economy, extract, overview, resolve
from lorespan.sources import corpus as corpus_source
from lorespan.sources.index_store import RELATIONS
from tests.code_samples import FILES


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    def stored(df, name):
        path = str(tmp_path_factory.mktemp("code") / name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    corpus = spark.createDataFrame(list(FILES.items()), "file string, content string").withColumn("language", paths.language_of(F.col("file")))
    return corpus, stored(extract.definitions(corpus), "symbols"), stored(extract.call_lines(corpus), "calls"), stored(extract.imports(corpus), "imports")


def ask(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "request_id bigint, name string")


@pytest.fixture(scope="module")
def answers(spark, code):
    corpus, symbols, calls, imports = code
    commits = spark.createDataFrame(
        [("shop/tax.py", "aaa", dt.datetime(2024, 1, 1)), ("shop/tax.py", "bbb", dt.datetime(2024, 2, 1))], "file string, commit string, author_ts timestamp"
    )
    out = resolve.resolve(ask(spark, "add_tax", "Round_Up", "und_u", "nothing_here"), symbols, calls, imports, corpus, resolve.last_commits(commits))
    return {r.request_id: r for r in out.collect()}


def test_exact(answers):
    r = answers[0]
    assert (r.name, r.kind, r.file, r.start_line, r.tier) == ("add_tax", "function", "shop/tax.py", 1, 1)
    assert r.source_code == "def add_tax(value):\n    return value * 1.2"
    assert r.last_commit_hash == "bbb"
    assert [c.file for c in r.callers] == ["shop/service.py"]
    assert [(t.file, t.enclosing_test) for t in r.tests] == [("tests/test_tax.py", "test_add")]
    assert r.importers == ["shop/service.py", "tests/test_tax.py"]
    assert (r.n_callers, r.n_tests, r.n_importers) == (1, 1, 2)


def test_case_insensitive_then_part(answers):
    assert (answers[1].name, answers[1].tier) == ("round_up", 2)
    # A call outside a test function of a test file is an ordinary caller.
    assert [(c.file, c.line) for c in answers[1].callers] == [("tests/test_tax.py", 15)]
    assert [t.enclosing_test for t in answers[1].tests] == ["test_round"]
    assert (answers[2].name, answers[2].tier) == ("round_up", 3)


def test_unknown(answers):
    r = answers[3]
    assert (r.name, r.kind, r.file, r.source_code, r.n_candidates) == ("nothing_here", "unknown", "", "", 0)
    assert r.callers is None and r.n_callers == 0


def symbol(spark, *rows):
    full = [(n, k, f, s, e, n, "python", i) for i, (n, k, f, s, e) in enumerate(rows)]
    return spark.createDataFrame(full, RELATIONS["symbols"])


def test_ambiguous_takes_first_and_counts(spark):
    symbols = symbol(spark, ("f", "function", "b.py", 1, 2), ("f", "class", "a.py", 9, 9), ("f", "function", "a.py", 3, 4))
    r = resolve.definitions(ask(spark, "f"), symbols).first()
    assert (r.file, r.start_line, r.n_candidates) == ("a.py", 3, 3)
    assert resolve.candidates(ask(spark, "f"), symbols).count() == 3


@pytest.mark.parametrize(
    "asked, expected",
    [
        ("a_c", {("aXc", 2), ("A_C", 2), ("xaxcx", 3)}),
        ("A%c", {("aXc", 2), ("A_C", 2), ("xaxcx", 3)}),
        ("é", {("caé", 3)}),
        ("É", set()),
        ("\\", {("b\\s", 3)}),
        ("__", {("ab", 2), ("aXc", 3), ("A_C", 3), ("xaxcx", 3), ("caé", 3), ("b\\s", 3)}),
    ],
)
def test_patterns_keep_wildcards(spark, asked, expected):
    names = spark.createDataFrame([(n,) for n in ("aXc", "A_C", "xaxcx", "caé", "b\\s", "ab")], "name string")
    got = resolve.pattern_matches(ask(spark, asked), names).collect()
    assert {(r.name, r.tier) for r in got} == expected


def test_enclosing_test_ignores_case_and_kind(spark):
    symbols = symbol(spark, ("TestAll", "class", "test_x.py", 1, 20), ("testOne", "method", "test_x.py", 2, 5), ("other", "function", "test_x.py", 3, 4))
    sites = spark.createDataFrame(
        [(0, "test_x.py", 3, 0), (0, "test_x.py", 9, 0), (0, "x.py", 3, 0)],
        "request_id bigint, file string, line int, no int",
    )
    got = {(r.file, r.line): r.enclosing_test for r in resolve.with_enclosing_test(sites, symbols, F.lit("python")).collect()}
    assert got == {("test_x.py", 3): "testOne", ("test_x.py", 9): "TestAll", ("x.py", 3): ""}


def test_naive_costs(spark, code):
    corpus, symbols, calls, imports = code
    sizes = economy.file_tokens(corpus)
    want = {f: len(t) // 4 for f, t in FILES.items()}
    assert {r.file: r.tokens for r in sizes.collect()} == want
    defs = resolve.definitions(ask(spark, "add_tax"), symbols)
    cost = economy.naive_resolve_cost(defs, resolve.callers(defs, calls), resolve.importers(defs, imports), sizes).first()
    assert cost.naive_tokens == sum(want[f] for f in ("shop/tax.py", "shop/service.py", "tests/test_tax.py"))
    hits = spark.createDataFrame([(7, "shop/tax.py"), (7, "shop/tax.py"), (7, "cmd/main.go")], "query_id bigint, file string")
    r = economy.naive_search_cost(hits, sizes).first()
    assert (r.matched_files, r.grep_overhead, r.naive_tokens) == (2, 10, 10 + want["shop/tax.py"] + want["cmd/main.go"])
    assert economy.naive_overview_cost(sizes).first().naive_tokens == sum(want.values())


def test_overview(spark, code):
    corpus, symbols, _, _ = code
    meta = corpus_source.file_meta(corpus.withColumn("content_hash", F.lit("h")), F.lit(1000.0))
    r = overview.overview(meta, symbols).first()
    assert r.files == 6 and r.symbols == symbols.count()
    assert r.languages == "python (3), go (1), javascript (1), rust (1)"
    assert r.entry_points == 2 and r.test_files == 1 and r.test_dirs == "tests"
    assert r.test_functions == 1  # test_add is a method, TestTax a class
    assert [x.file for x in overview.entry_points(meta).collect()] == ["web/app.js", "cmd/main.go"]
    assert overview.top_languages(meta, 1).first().languages == "python (3)"
    fresh = overview.freshness(meta, F.lit(1000.0 + 25 * 3600)).first()
    assert (fresh.age_hours, fresh.stale) == (25.0, True)
    assert [x.file for x in resolve.list_files(meta).collect()] == sorted(FILES)


def test_no_test_files_gives_no_row(spark):
    meta = spark.createDataFrame([("a.py",)], "file string")
    assert overview.test_summary(meta, symbol(spark, ("test_x", "function", "a.py", 1, 1))).count() == 0


def test_module_of_root_file(spark):
    symbols = symbol(spark, ("a", "function", "m.py", 1, 1), ("b", "function", "p/q/m.py", 1, 1), ("c", "function", "p/m.py", 1, 1), ("d", "function", "p/m.py", 2, 2))
    assert [tuple(r) for r in overview.module_summary(symbols).collect()] == [("p", 2, 3), (".", 1, 1)]


def shuffled(df):
    """Names of the columns that the shuffles of a query hold, once it has run."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        elif kind == "ShuffleExchangeExec":
            out |= {plan.output().apply(i).name() for i in range(plan.output().size())}
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return out


def test_definitions_are_not_shuffled_to_be_found(spark, tmp_path):
    """Few names are asked for, and the definitions are more than Spark would broadcast."""
    rows = spark.range(20_000).select(
        F.format_string("n%d", F.col("id") % 500).alias("name"), F.lit("function").alias("kind"), F.format_string("%d.py", F.col("id") % 300).alias("file"),
        F.col("id").cast("int").alias("start_line"), F.col("id").cast("int").alias("end_line"), F.sha2(F.col("id").cast("string"), 512).alias("signature"),
        F.lit("python").alias("language"), F.col("id").cast("int").alias("no"),
    )
    rows.write.parquet(str(tmp_path / "symbols"))
    symbols, asked = spark.read.parquet(str(tmp_path / "symbols")), ask(spark, "n7", "N8", "none")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "50k")
        assert not {"file", "kind", "signature"} & shuffled(resolve.candidates(asked, symbols))
        found = resolve.definitions(asked, symbols)
        assert not {"signature", "kind"} & shuffled(found)
    finally:
        spark.conf.set(limit, before)
    rows = symbols.collect()
    for r in found.collect():
        want = sorted((d.file, d.start_line, d.signature) for d in rows if d.name == r.asked.lower())
        assert ((r.file, r.start_line, r.signature) == want[0]) if want else r.kind == "unknown"
        assert r.n_candidates == len(want)


def test_first_definition_of_equal_places_and_nulls(spark):
    """Definitions of one place differ by text only, requests of one id are answered together."""
    symbols = spark.createDataFrame([
        ("f", "function", None, 2, 3, "def f(b)", "python", None), ("f", "function", None, 2, 3, "def f(a)", "rust", None), ("f", "function", "a.py", 1, 1, "x", None, 0),
        ("F", "class", "b.py", 1, 1, None, "go", 1), ("F", "class", "b.py", 1, 1, "class F", "go", 1),
    ], RELATIONS["symbols"])
    requests = spark.createDataFrame([(1, "f"), (2, "F"), (3, "F"), (3, "f"), (None, "f"), (4, None)], "request_id bigint, name string")
    found = sorted((r.request_id, r.asked, r.file, r.signature, r.language, r.tier, r.n_candidates) for r in resolve.definitions(requests, symbols).collect() if r.request_id and r.request_id < 4)
    none = ("", "def f(a)", "rust", 1)
    assert found == [(1, "f", *none, 3), (2, "F", "b.py", "", "go", 1, 2), (3, "F", *none, 5), (3, "f", *none, 5)]
