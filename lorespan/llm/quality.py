"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the statistics; every path of a tree is a conjunctive rule. A lasso logistic
regression over the rules and the scaled statistics keeps few of them. The kept rules compile into one
Spark column expression, so scoring is a scan.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.llm.common import fresh, stored

#: Labelled rows that training uses at most: the smallest by a hash of id and text. 20,000 rows fix some
#: hundred weights well; scoring and statistics always cover all rows.
TRAIN_ROWS = 20_000
SEED = 7
TREES, DEPTH = 16, 4
LASSO = 0.001


NAMES = (
    "log_words", "mean_word", "symbols", "marks", "upper", "digits", "letters",
    "distinct_words", "log_distinct", "distinct_lines", "log_lines", "words_a_line",
)
_UPPER, _DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
_MARKS = b".,;:!?'\"()-"
_LETTERS = string.ascii_letters.encode() + bytes(range(128, 256))


def text_numbers(text: str | None) -> tuple[float, ...]:
    """The statistics of one text in the order of ``NAMES``; null counts as empty, ratios of nothing are 0.

    Lengths are bytes of UTF-8; a byte beyond ASCII counts as a letter.
    """
    data = text.encode() if text else b""
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    size, n = len(data), len(words)
    distinct = len(set(words))
    plain = data.translate(None, _LETTERS)
    signs = plain.translate(None, _DIGITS + b" \t\n\v\f\r")

    def share(part: float, whole: float) -> float:
        return part / whole if whole else 0.0

    return (
        math.log1p(n), min(share(size, n), 50.0), share(len(signs.translate(None, _MARKS)), size),
        share(len(signs) - len(signs.translate(None, _MARKS)), size), share(size - len(data.translate(None, _UPPER)), size),
        share(len(plain) - len(plain.translate(None, _DIGITS)), size), share(size - len(plain), size),
        share(distinct, n), math.log1p(distinct), share(len(set(lines)), len(lines)), math.log1p(len(lines)),
        math.log1p(share(n, len(lines))),
    )


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text column, computed batch by batch."""

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES]))
    def numbers(texts: pa.Array) -> pa.Array:
        rows = [text_numbers(x.as_py()) for x in texts]
        columns = [pa.array(c, pa.float64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(NAMES))]
        return pa.StructArray.from_arrays(columns, names=list(NAMES))

    return numbers(text)


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds on statistics: (statistic, is an upper bound, bound)."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self, prefix: str = "") -> Column:
        tests = [F.col(prefix + name) <= bound if upper else F.col(prefix + name) > bound for name, upper, bound in self.bounds]
        both = tests[0]
        for test in tests[1:]:
            both = both & test
        return both.cast("double")


@dataclass(frozen=True)
class RuleModel:
    """Weights of rules and of scaled statistics, all that a score needs."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    linear: tuple[tuple[str, float], ...]

    def probability(self, prefix: str = "") -> Column:
        """Probability of label 1 from columns named as the statistics, after a prefix."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.lit(weight) * rule.column(prefix)
        for name, weight in self.linear:
            total = total + F.lit(weight) * F.col(prefix + name)
        return 1.0 / (1.0 + F.exp(-total))


def tree_rules(node, names: list[str], path: tuple = ()) -> list[Rule]:
    """One rule for every node below the root: the bounds on the way to it, joined per statistic."""
    found = []
    if path:
        tight: dict[tuple[str, bool], float] = {}
        for name, upper, bound in path:
            old = tight.get((name, upper))
            tight[name, upper] = bound if old is None else min(old, bound) if upper else max(old, bound)
        found.append(Rule(tuple(sorted((n, u, b) for (n, u), b in tight.items()))))
    if node.numDescendants() > 0:
        split = node.split()
        name, bound = names[split.featureIndex()], split.threshold()
        found += tree_rules(node.leftChild(), names, (*path, (name, True, bound)))
        found += tree_rules(node.rightChild(), names, (*path, (name, False, bound)))
    return found


def fit(training: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """Fits the ensemble on a table of statistics with a 0/1 label; labels of one kind only give a constant.

    ``training`` is bounded by its caller; no rows give the score 0.5.
    """
    names = [c for c in training.columns if c != label]
    counts = {r[0]: r[1] for r in training.groupBy(label).count().collect()}
    if len(counts) < 2:
        n = sum(counts.values())
        share = (counts.get(1, 0) + 1) / (n + 2)
        return RuleModel(math.log(share / (1 - share)), (), ())
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(training).select("x", F.col(label).cast("double").alias("y"), *names)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=SEED, maxBins=64, subsamplingRate=0.7, minInstancesPerNode=5).fit(rows)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree._call_java("rootNode"), names)))
    place = {n: k for k, n in enumerate(names)}

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            found = [np.all([stats[:, place[n]] <= b if u else stats[:, place[n]] > b for n, u, b in r.bounds], axis=0) for r in rules]
            table = np.column_stack([*found, stats]).astype(float)
            offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
            yield pa.record_batch([batch.column("y"), pa.ListArray.from_arrays(offsets, table.ravel())], names=["y", "x"])

    vectors = rows.select("y", *names).mapInArrow(fired, "y double, x array<double>").select("y", array_to_vector("x").alias("x"))
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=lasso, elasticNetParam=1.0, maxIter=60, standardization=True).fit(vectors)
    weights = model.coefficients.toArray()
    kept = tuple((r, float(w)) for r, w in zip(rules, weights, strict=False) if w)
    linear = tuple((n, float(w)) for n, w in zip(names, weights[len(rules) :], strict=True) if w)
    return RuleModel(float(model.intercept), kept, linear)


def training_rows(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and label of at most ``rows`` labelled documents outside the held-out fold.

    Fold: crc32 of the id as text, mod 5; 0 is held out. Rows with null id or label, labels other than 0 and 1
    and ids with labels of both kinds teach nothing.
    """
    known = labels.filter(F.col(target).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.min(target).alias("label"), F.max(target).alias("most")).filter("label = most")
    # the smallest hashes of ids are the sample; only these ids are then looked up in the documents
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows).select("doc_id", "label")
    # at most ``rows`` ids, so every task can hold them
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = found.select(F.col("label").cast("int").alias("label"), statistics(F.col("text")).alias("stats"))
    return found.select("label", *(F.col(f"stats.{n}").alias(n) for n in NAMES))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> RuleModel:
    return fit(stored(training_rows(docs, labels, target, rows), "quality_training"))


def with_score(docs: DataFrame, model: RuleModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability that the text is good; null and empty texts have a score too.

    Rows stay as they are; a column of the name asked for is replaced.
    """
    stats = fresh(docs, "stats")
    wide = docs.withColumn(stats, statistics(F.col(text_col)))
    return wide.withColumn(name, model.probability(f"{stats}.")).drop(stats)
