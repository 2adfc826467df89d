import math
import random

import numpy as np
import pytest
from llm_rows import documents, empty, odd_rows, sentence
from pyspark.sql import functions as F

from lorespan.llm import quality, topk


def brute(rows, k=20):
    valid = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in valid:
        if q % 20 == 0:
            scored = sorted((-sum(map(lambda a, b: a * b, v, w)), i) for i, w in valid if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_top_k_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(5, 8))
    rows = [(n, [float(np.float32(x)) for x in centers[n % 5] + spread * rng.normal(size=8)]) for n in range(700)]
    rows += [(2000, None), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (None, [1.0] * 8), (2060, [float("inf")] + [0.0] * 7)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_cover_tree_covers():
    points = np.random.default_rng(1).normal(size=(900, 2))
    root, order = topk.cover_tree(points, np.arange(900), leaf=8)
    assert sorted(order) == list(range(900)) and root.children

    def check(node):
        assert (np.linalg.norm(points[order[node.first : node.end]] - node.center, axis=1) <= node.radius).all()
        for child in node.children:
            check(child)

    check(root)


def test_few_and_no_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id long, rank int")
    assert topk.top_k(table([]), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(table([(0, [1.0], 1, 1)]), F.col("vec_id") % 20 == 0).collect() == []
    few = topk.top_k(table([(0, [1.0], 1, 1), (3, [2.0], 1, 1), (2, [2.0], 1, 1)]), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, few.collect())) == [(0, 1, 2, 8192), (0, 2, 3, 8192)]


def good_and_bad(n):
    rng = random.Random(11)
    rows = []
    for k in range(n):
        text = sentence(rng, rng.randrange(30, 200))
        bad = k % 5 == 0
        rows.append((k, " ".join(f"{w}$$$" for w in text.split()) if bad and k % 2 else text.upper() + "!!" if bad else text, "s0"))
    return rows, [(k, int(k % 5 != 0), 0) for k in range(n)]


def test_rules_learn_and_every_row_has_a_score(spark):
    rows, labels = good_and_bad(400)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, 0, 0), (4, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(documents(spark, rows), marks)
    assert model.rules
    docs = documents(spark, rows + odd_rows())
    scored = quality.with_score(docs, model)
    assert scored.columns == docs.columns
    assert scored.filter("score is null or score < 0 or score > 1").count() == 0 and scored.count() == 400 + len(odd_rows())
    held = [r for r in quality.with_score(documents(spark, rows).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0), model).filter("held").collect()]
    right = sum((r.score >= 0.3) == (r.doc_id % 5 != 0) for r in held)
    assert len(held) > 40 and right / len(held) > 0.95


def test_labels_missing_or_of_one_kind(spark):
    rows, _ = good_and_bad(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(n, 1, 0) for n in range(20)], "doc_id long, quality int, toxic int")
    assert quality.with_score(documents(spark, rows), quality.train(documents(spark, rows), none)).agg(F.max("score")).first()[0] == 0.5
    assert quality.with_score(documents(spark, rows), quality.train(documents(spark, rows), ones)).agg(F.min("score")).first()[0] > 0.9
    assert quality.with_score(empty(spark), quality.train(empty(spark), ones)).collect() == []


def test_statistics_read_whole_texts():
    names = dict(zip(quality.NAMES, quality.text_numbers("word " * 50_000 + "$" * 50_000), strict=True))
    assert names["log_words"] == pytest.approx(math.log1p(50_001)) and names["symbols"] == pytest.approx(50_000 / 300_000)
    assert quality.text_numbers(None) == quality.text_numbers("")


@pytest.mark.parametrize("kind", ["clusters", "uniform", "equal", "line"])
def test_cover_trees_cover_their_points(kind):
    rng = np.random.default_rng(3)
    points = {"clusters": lambda: rng.integers(-40, 40, (30, 16))[rng.integers(0, 30, 5000)] + rng.integers(-2, 3, (5000, 16)), "uniform": lambda: rng.integers(-30, 30, (3000, 16)), "equal": lambda: np.ones((700, 8)), "line": lambda: np.arange(3000)[:, None] * np.ones((1, 4))}[kind]().astype(float)
    root, order = topk.cover_tree(points, np.arange(len(points)))
    assert sorted(order.tolist()) == list(range(len(points)))
    todo, leaves = [root], 0
    while todo:
        node = todo.pop()
        inside = points[order[node.first : node.end]]
        assert np.sqrt(((inside - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        if node.children:
            assert [c.first for c in node.children] + [node.end] == [node.first] + [c.end for c in node.children]
            todo += node.children
        else:
            leaves += 1
            assert node.end - node.first <= topk.LEAF or node.radius == 0
    assert leaves > 1 or kind == "equal"


def test_clustered_vectors_are_mostly_not_scored():
    """Pairs of nodes are dropped by their radii; what is found is what a full product finds."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-200, 200, (40, 32))
    points = (centers[rng.integers(0, 40, 12_000)] + rng.integers(-3, 4, (12_000, 32))).astype(float)
    ids = np.arange(len(points))
    asked = ids % 20 == 0
    best = topk.TopK(points[asked], ids[asked], 20)
    best.add(points, ids)
    assert best.scored / best.pairs < 0.2
    scores = points[asked] @ points.T
    for q in range(0, asked.sum(), 37):
        row = int(best.ids[q])
        all_scores = points[row] @ points.T
        want = sorted(((-s, i) for i, s in enumerate(all_scores.tolist()) if i != row))[:20]
        assert [(-s, i) for s, i in zip(best.scores[q].tolist(), best.found[q].tolist(), strict=True)] == want
    assert len(scores) == asked.sum()


def test_search_of_repeated_ids_and_few_rows(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 0.5]), (1, [3.0, 1.0]), (40, [1.0]), (2, [2.0]), (60, [0.0, 0.0, 1.0]), (None, [1.0, 1.0]), (80, None), (3, [float("nan"), 1.0])]
    found = topk.top_k(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, v string, score string"), F.col("vec_id") % 20 == 0, k=5, scale=1)
    assert sorted(map(tuple, found.collect())) == [(20, 1, 1, 3), (40, 1, 2, 2)]


def statistics_by_hand(text):
    """The statistics by their names, character by character, on ASCII texts."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    of = lambda test: sum(map(test, text)) / len(text) if text else 0.0
    marks = ".,;:!?'\"()-"
    sign = lambda c: not c.isalnum() and not c.isspace()
    return {
        "log_words": math.log(1 + len(words)), "mean_word": min(len(text) / len(words), 50) if words else 0.0, "symbols": of(lambda c: sign(c) and c not in marks),
        "marks": of(lambda c: c in marks), "upper": of(str.isupper), "digits": of(str.isdigit), "letters": of(str.isalpha),
        "distinct_words": len(set(words)) / len(words) if words else 0.0, "log_distinct": math.log(1 + len(set(words))), "distinct_lines": len(set(lines)) / len(lines) if lines else 0.0,
        "log_lines": math.log(1 + len(lines)), "words_a_line": math.log(1 + len(words) / len(lines)) if lines else 0.0,
    }


def test_scores_equal_the_rules_by_hand(spark):
    """Every score is the model's rules and weights evaluated one after the other in plain Python."""
    rng = random.Random(31)
    good = [sentence(rng, rng.randrange(5, 120)) + "." for _ in range(150)]
    bad = ["".join(rng.choice("$#@% ABC09!\n") for _ in range(rng.randrange(1, 400))) for _ in range(150)]
    rows = [(n, t, "s") for n, t in enumerate([*good, *bad, "", None, "one", "a\n\nb b\n"])]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(n, int(n < 150)) for n in range(300)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.rules and model.linear
    for r in quality.with_score(docs, model, name="p").collect():
        stats = statistics_by_hand(r.text)
        total = model.intercept + sum(w * stats[n] for n, w in model.linear)
        for rule, weight in model.rules:
            total += weight * all(stats[n] <= b if upper else stats[n] > b for n, upper, b in rule.bounds)
        assert r.p == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), r.text
