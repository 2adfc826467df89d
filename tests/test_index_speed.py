"""What an index run and a search of many queries do once, and that the short ways give what the long ones do."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lorespan.functions import text
from lorespan.operators import prose, scan, search
from lorespan.sources import index_store

ODD = list("aZ9é _-'İßΣⅠ中\t\n\r\x0b\x1c\x85 ́\x00") + ["\r\n", " ", "b", "É"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_odd_texts_part_as_before(spark):
    """Lines, words and tokens by the one pattern of each; the short ways for plain texts must not show."""
    rng = random.Random(4)
    texts = [None, "", "plain", "Été", "a b", "a\n", "\n", "İ"] + ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 12))) for _ in range(2000)]
    t = F.col("t")
    tokens = text.words(F.translate(F.lower(F.coalesce(t, F.lit(""))), text.FOLD_FROM, text.FOLD_TO))
    end = F.regexp_replace(t, f"(?:{text.LINE_BREAK})\\z", "")
    lines = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(end, text.LINE_BREAK))
    pairs = [
        (text.lines(t), lines), (text.first_line(t), F.get(lines, 0)), (text.index_tokens(t), tokens), (text.n_tokens(t), F.size(tokens)),
        (F.transform(text.lower_tokens(t), text.unaccented), tokens), (text.rtrim_space(t), F.regexp_replace(t, r"[\s\x0B]+$", "")),
        (F.nullif(text.first_word(t), F.lit("")), F.get(text.words(t), 0)), (text.has_words(t), F.size(text.words(t)) > 1),
    ]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[a.eqNullSafe(b).alias(f"same{i}") for i, (a, b) in enumerate(pairs)])
    assert [r for r in rows.collect() if r.t is not None and not all(r[1:]) or r.t is None and not all(r[1:-1])] == []
    names = [[], ["a"], ["a", "é"], ["a b"], ["a\nb"], ["a", None], ["", "a"], ["İ", "a"], None]
    many = spark.createDataFrame([(n,) for n in names], "n array<string>")
    each = many.select(text.each_n_tokens(F.col("n")).alias("a"), F.transform("n", text.n_tokens).alias("b")).collect()
    assert [r.a for r in each] == [r.b for r in each]


def test_a_line_is_parted_once(spark):
    """A filter on the number of words would part each line another time."""
    files = spark.createDataFrame([("a.txt", "en", "one two\nthree\n\nfour five six\n")], "file string, language string, content string")
    lines = prose.call_lines(files)
    assert plan(lines).count(f"{text.TOKEN_GAP}, -1") == 1
    assert [(r.line, r.context, [x.name for x in r.refs]) for r in lines.collect()] == [(1, "one two", ["two"]), (4, "four five six", ["five", "six"])]
    calls = spark.createDataFrame([("f", "a.txt", 1, 0)], "symbol_name string, file string, line int, no int")
    assert re.findall(r"Sort \[(.*?)\], false", plan(index_store.by_name(calls)))[0].count("ASC") == 1  # numbers only


def test_scores_follow_the_terms_of_a_row(monkeypatch):
    """Each term of a row adds to the queries that have it, however few parts are held at once."""
    rng = np.random.default_rng(2)
    n_rows, n_terms, ids = 20, 300, ["a", "b", "c"]
    weights = [{int(t): float(rng.random()) for t in rng.choice(n_terms, 40, replace=False)} for _ in ids]
    row, term = np.divmod(np.sort(rng.choice(n_rows * n_terms, 900, replace=False)), n_terms)
    low, high = rng.random(900), rng.random(900)
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(scan, "PARTS", most)
        found = scan._Asked(ids, weights, n_terms, 5).scores(n_rows, row, term, low, high)
        for scores, part in zip(found, (low, high), strict=True):
            told = np.zeros((n_rows, 3))
            for r, t, p in zip(row, term, part, strict=True):
                for q in range(3):
                    told[r, q] += p * weights[q].get(int(t), 0.0)
            assert np.allclose(scores, told)
    assert not scan._Asked(ids, weights, n_terms, 5).scores(2, row[:0], term[:0], low[:0])[0].any()


def test_few_hits_are_not_written_down(spark):
    """The best of few queries are broadcast within the plan, those of many are written first."""
    symbols = spark.createDataFrame([("token", "function", "a.txt", 1, 1, "token x", "en", 0)], index_store.RELATIONS["symbols"])
    lines = spark.createDataFrame([("a.txt", 1, "token x", [("x", "x")])], index_store.RELATIONS["call_lines"])
    index = search.TextIndex.of(symbols, lines)
    found = search.search_symbols(index, search.literal_terms(spark, "tok"))
    assert "search_best" not in "".join(found.inputFiles()) and "Window" in plan(found) and [r.name for r in found.collect()] == ["token"]
    many = search.search_symbols(index, search.literal_terms(spark, "tok"), limit=search.FEW + 1)
    assert "search_best" in "".join(many.inputFiles()) and [r.name for r in many.collect()] == ["token"]
