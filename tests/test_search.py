"""Ranks against the formula worked by hand, query building, merge rules, limits."""

import math
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespan.functions import paths, text
from lorespan.operators import extract, search
from lorespan.sources.index_store import RELATIONS
from tests.code_samples import FILES


def match(spark, query):
    df = spark.createDataFrame([(query,)], "q string")
    return df.select(search.match_expression(F.col("q")).alias("m")).first().m


def test_query_builder(spark):
    assert match(spark, "auth token 401") == 'auth* OR token* OR "401"'
    assert match(spark, "validate") == "validate*"
    assert match(spark, "") == ""
    assert match(spark, "  (Auth),  'x'!  ... ") == "auth* OR x*"


QUERIES = ["auth token 401", "validate_token", "Été Écho", "a/b.c x", "(x)", "42 42", "...", "", "foo_12 12_foo"]


def test_both_parsers_agree(spark):
    df = spark.createDataFrame(list(enumerate(QUERIES)), "query_id bigint, query string")
    table = {}
    for r in search.query_terms(df).collect():
        table.setdefault(r.query_id, []).append((r.term_no, r.n_toks, r.tok_no, r.tok, r.is_prefix))
    for i, q in enumerate(QUERIES):
        parsed = [(t.term_no, t.n_toks, t.tok_no, t.tok, t.is_prefix) for t in search.parse_query(q)]
        assert sorted(table.get(i, [])) == sorted(parsed)
        literal = [tuple(r)[1:] for r in search.literal_terms(spark, q).collect()]
        assert sorted(literal) == sorted(parsed)


def test_strict_syntax_empties_query(spark):
    df = spark.createDataFrame([(0, "good a/b"), (1, "snake_case été")], "query_id bigint, query string")
    got = {r.query_id for r in search.query_terms(df, strict_syntax=True).collect()}
    assert got == {1}
    assert {r.query_id for r in search.query_terms(df).collect()} == {0, 1}


def test_fold(spark):
    df = spark.createDataFrame([("Été_naïve Straße ÑANDÚ",)], "t string")
    assert df.select(text.index_tokens(F.col("t")).alias("x")).first().x == ["ete", "naive", "straße", "nandu"]


SYMBOLS = [
    ("validate_token", "function", "auth/jwt.py", 10, 20, "def validate_token(token):", "python", 0),
    ("token", "function", "auth/other.py", 1, 2, "def token():", "python", 0),
    ("revalidate", "class", "auth/other.py", 5, 9, "class revalidate:", "python", 1),
    ("x", "function", "b/401.py", 1, 2, None, "python", 0),
    ("y", "function", "b/token/y.py", 3, 4, "def y(tokens, token_401):", "python", 0),
]
CALLS = [
    ("auth/app.py", 3, "    ok = validate_token(raw) or token()", [("validate_token", "validate_token"), ("token", "token")]),
    ("auth/app.py", 8, "check(401, token)", [("check", "check")]),
    ("b/z.py", 2, "nothing()", [("nothing", "nothing")]),
]


@pytest.fixture(scope="module")
def index(spark):
    return search.TextIndex.of(
        spark.createDataFrame(SYMBOLS, RELATIONS["symbols"]), spark.createDataFrame(CALLS, RELATIONS["call_lines"])
    )


def tokens(s):
    out, cur = [], ""
    for ch in (s or "").lower() + " ":
        if ch.isalnum():
            cur += ch
        elif cur:
            out.append(cur)
            cur = ""
    return out


def brute(rows, query):
    """BM25 over lists of token columns, term by term."""
    terms = []
    for w in query.lower().split():
        toks = tokens(w)
        terms.append((toks, w.isdigit()))
    def freq(cols, toks, exact):
        n = 0
        for c in cols:
            for i in range(len(c) - len(toks) + 1):
                head = all(c[i + k] == toks[k] for k in range(len(toks) - 1))
                last = c[i + len(toks) - 1]
                n += head and (last == toks[-1] if exact else last.startswith(toks[-1]))
        return n
    lens = [sum(map(len, cols)) for cols in rows]
    avg = sum(lens) / len(lens)
    rank = Counter()
    for toks, exact in terms:
        f = [freq(cols, toks, exact) for cols in rows]
        n = sum(x > 0 for x in f)
        if not n:
            continue
        idf = math.log((len(rows) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, x in enumerate(f):
            if x:
                rank[i] -= idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * lens[i] / avg))
    return rank


@pytest.mark.parametrize("query", ["token 401", "validate_token", "token token 401", "tok val", "py", "zzz"])
def test_symbol_rank(spark, index, query):
    rows = [[tokens(s[0]), tokens(s[1]), tokens(s[2]), tokens(s[5])] for s in SYMBOLS]
    want = {(SYMBOLS[i][2], SYMBOLS[i][7]): r for i, r in brute(rows, query).items()}
    got = {(r.file, r.no): r["rank"] for r in search.search_symbols(index, search.literal_terms(spark, query)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8)


@pytest.mark.parametrize("query", ["token 401", "validate_token", "app", "nothing"])
def test_call_rank(spark, index, query):
    flat = [(f, line, ctx, i, name) for f, line, ctx, refs in CALLS for i, (name, _) in enumerate(refs)]
    rows = [[tokens(c[4]), tokens(c[0]), tokens(c[2])] for c in flat]
    want = {(flat[i][0], flat[i][1], flat[i][3]): r for i, r in brute(rows, query).items()}
    got = {(r.file, r.line, r.no): r["rank"] for r in search.search_calls(index, search.literal_terms(spark, query)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-8)


def test_prune_changes_nothing(spark, index):
    q = "token_401 val 401"
    terms = search.literal_terms(spark, q)
    full = search.search(index, terms).orderBy("place").collect()
    pruned = search.search(index.only(search.token_filter(q)), terms).orderBy("place").collect()
    assert full == pruned and full


def test_merge(spark, index):
    rows = {r.name: r for r in search.search(index, search.literal_terms(spark, "token")).collect()}
    assert rows["token"].call_context == CALLS[0][2]        # found itself, context from its call
    assert rows["validate_token"].call_line == 3
    assert rows["check"].kind == "call"                     # no definition: the call itself
    assert rows["check"].start_line == rows["check"].end_line == 8
    assert rows["check"].signature == CALLS[1][2] and rows["check"].language == ""
    assert rows["y"].call_context == "" and rows["y"].call_line == 0
    places = [r.place for r in sorted(rows.values(), key=lambda r: (r["rank"], r.file, r.start_line, r.name))]
    assert places == sorted(places)


def test_limit_holds_in_every_pass(spark, index):
    terms = search.literal_terms(spark, "token")
    assert search.search(index, terms, limit=2).count() == 2
    assert search.search_symbols(index, terms, limit=1).count() == 1


def test_no_results(spark, index):
    assert search.search(index, search.literal_terms(spark, "xyznonexistent123")).count() == 0
    assert search.search(index, search.literal_terms(spark, "")).count() == 0


def test_on_code(spark, tmp_path):
    corpus = spark.createDataFrame(list(FILES.items()), "file string, content string").withColumn("language", paths.language_of(F.col("file")))
    index = search.TextIndex.build(spark, extract.definitions(corpus), extract.call_lines(corpus), str(tmp_path))
    names = lambda q: [r.name for r in search.search(index, search.literal_terms(spark, q)).orderBy("place").collect()]
    assert "add_tax" in names("add tax")
    assert "NewServer" in names("newserver")
    listed = search.hits_by_file(search.search(index, search.literal_terms(spark, "tax"))).collect()
    assert [r.first_place for r in listed] == sorted(r.first_place for r in listed)
    assert sum(r.hits for r in listed) == len(names("tax"))


def test_texts_are_not_shuffled_for_the_hits(spark):
    """Definitions and call lines meet the few rows that are shown where they lie, however large their texts are."""
    symbols = spark.range(400).selectExpr(
        "concat('n', id) AS name", "'function' AS kind", "concat('f', id, '.py') AS file", "1 AS start_line", "2 AS end_line",
        "concat('w', id % 7, ' ', repeat(sha2(string(id), 512), 8)) AS signature", "'python' AS language", "0 AS no",
    )
    lines = symbols.selectExpr("file", "1 AS line", "signature AS context", "array(named_struct('name', name, 'full_name', name)) AS refs")
    index = search.TextIndex.build(spark, symbols, lines, tempfile.mkdtemp())
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "20000")
    try:
        for find in (search.search_symbols, search.search_calls, search.search):
            found = find(index, search.literal_terms(spark, "w3 n17"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            shuffled = [x for x in plan.splitlines() if "Join" in x and "SortMerge" in x]
            assert not [x for x in shuffled if "file" in x or "LeftSemi" in x], plan
            assert found.count() == 15
    finally:
        spark.conf.set(name, before)


def test_scan_finds_what_postings_find(spark, monkeypatch):
    """Queries that most rows meet, in both ways: phrases, prefixes, numbers, repeated and null keys. What is written for
    the bounds does not grow with rows x queries."""
    rng = random.Random(3)
    words = ["en", "ent", "enter", "a", "ab", "abc", "of", "off", "12", "123", "é", "src", "x_y", "Zed", "zed", "to"]
    symbols, calls = [], []
    for f in range(200):
        file = f"{rng.choice(words)}/{rng.choice(words)}{f if f % 9 else 0}.txt"
        for n in range(rng.randint(1, 9)):
            text_ = " ".join(rng.choices(words, k=rng.randint(0, 9)))
            symbols.append((rng.choice(words), "function", file, n + 1, n + 1, text_, "en", n))
            names = rng.choices([*words, "a.b", "ab-en"], k=rng.randint(0, 5))
            calls.append((file, n + 1, f"{text_}-{rng.choice(words)}", [(x, x) for x in names]))
    symbols += [*symbols[:5], ("q", "function", None, 1, 1, "en a", "en", 0)]
    calls.append((None, 1, "en ab", [("en", "en")]))
    asked = [(i, " ".join(rng.choices([*words, "en/a", "ab.en x", "of-off-to", "404"], k=rng.randint(0, 7)))) for i in range(20)]
    terms = search.query_terms(spark.createDataFrame(asked, "query_id bigint, query string"))
    index = search.TextIndex.of(spark.createDataFrame(symbols, RELATIONS["symbols"]), spark.createDataFrame(calls, RELATIONS["call_lines"]))
    written, stored = {}, search.stored

    def counting(df, name):
        out = stored(df, name)
        if name == "search_bounds":
            written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(search, "stored", counting)
    # tuples of text compare nulls too
    found = [sorted(str([f"{v:.7f}" if isinstance(v, float) else v for v in r]) for r in search.search(index, terms, 3, whole).collect()) for whole in (False, True)]
    assert found[0] == found[1] and len(found[0]) > 40
    of_lines, *scanned = written["search_bounds"]
    assert len(scanned) == 2 and scanned[1] < of_lines / 2
