"""Mixing sources to target weights by fitting budgets to exact document lengths.

Each source gets a target in words. Whole passes over the source come first; what is left of the budget is
fitted by document length: every length gives its share of documents, rounded down, then one more document
per length from the longest down while it fits, and a bounded knapsack over the lengths still open fills the
rest, which is less than one document. Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import fresh, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 13
#: Up to so many ways of taking documents their sums are listed, else they are marked in a table of words.
FEW_SUMS = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words. A target stops
    at ``most`` times its source; the excess goes to the others by weight until none is above. Solved at once:
    in the order of ``size / weight``, the first sources are at their cap and the rest share what is left. The
    table has a row per source, far fewer than documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = total * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("cap") > F.col("weight") * F.col("level"))
    # the level of the first source that stays below its cap holds for all after it
    final = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * final, F.col("cap")))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to add so that their words come nearest to ``budget``, below it in ties:
    bounded knapsack over lengths, by first reaching item, for budgets of any size.

    Lengths are distinct and positive. A sum that is nearer than none at all is below twice the budget, so the
    table ends there. Few long documents have few sums; these are listed instead.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    budget = int(budget)
    if budget <= 0:
        return taken
    most = 2 * budget
    usable = np.minimum(counts, most // lengths)
    if math.prod(int(n) + 1 for n in usable) <= FEW_SUMS:
        return _listed_sums(lengths, usable, budget)
    reached = np.full(most + 1, -1, dtype=np.int32)
    reached[0] = top = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for k in np.argsort(lengths, kind="stable"):
        left, batch = int(usable[k]), 1
        # numbers of copies as powers of two, so that any count up to ``left`` is a sum of them
        while left > 0 and reached[budget] < 0:
            copies = min(batch, left)
            step = copies * int(lengths[k])
            if step <= most:
                end = min(top, most - step) + 1
                new = np.flatnonzero((reached[:end] >= 0) & (reached[step : step + end] < 0)) + step
                reached[new] = len(items)
                items.append((int(k), copies))
                top = max(top, int(new[-1])) if len(new) else top
            left, batch = left - copies, batch * 2
        if reached[budget] >= 0:
            break
    sums = np.flatnonzero(reached >= 0)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        k, copies = items[reached[at]]
        taken[k] += copies
        at -= copies * int(lengths[k])
    return taken


def _listed_sums(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """``fit_budget`` by the sums themselves, length by length."""
    steps = [np.zeros(1, dtype=np.int64)]
    for length, n in zip(lengths, counts, strict=True):
        sums = np.unique(steps[-1][:, None] + np.arange(int(n) + 1, dtype=np.int64) * int(length))
        steps.append(sums[sums <= 2 * budget])
    at = int(steps[-1][np.argmin(np.abs(steps[-1] - budget))])
    taken = np.zeros(len(lengths), dtype=np.int64)
    for k in reversed(range(len(lengths))):
        taken[k] = next(n for n in range(int(counts[k]) + 1) if (at - n * int(lengths[k])) in steps[k])
        at -= int(taken[k]) * int(lengths[k])
    return taken


def _plan(lengths: DataFrame) -> DataFrame:
    """Documents to take per (source, size): whole passes and how many documents one more.

    ``lengths``: ``(source, size, n, source_size, target)``, a row per distinct length of a source.
    """
    rest = F.col("target") - F.col("passes") * F.col("source_size")
    based = lengths.withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    based = based.withColumn("rest", F.round(rest).cast("long")).withColumn("whole", F.floor(F.col("n") * F.coalesce(F.try_divide(rest, "source_size"), F.lit(0.0))).cast("long"))
    per = Window.partitionBy("source")
    down = per.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    based = based.withColumn("open", F.col("rest") - F.sum(F.col("whole") * F.col("size")).over(per))
    more = F.when(F.col("whole") < F.col("n"), F.col("size")).otherwise(0)
    based = based.withColumn("one", (F.sum(more).over(down) <= F.col("open")) & (more > 0))
    based = based.withColumn("whole", F.col("whole") + F.col("one").cast("long"))
    based = based.withColumn("open", F.col("open") - F.sum(F.when(F.col("one"), F.col("size")).otherwise(0)).over(per))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        free = ((rows["size"] > 0) & (rows["size"] <= 2 * rows["open"]) & (rows["whole"] < rows["n"])).to_numpy()
        if free.any():
            part = rows[free]
            added = fit_budget(part["size"].to_numpy(), (part["n"] - part["whole"]).to_numpy(), int(part["open"].iloc[0]))
            rows.loc[free, "whole"] = part["whole"] + added
        return rows[["source", "size", "n", "passes", "whole"]]

    columns = based.select("source", "size", "n", "passes", "whole", "open")
    return columns.groupBy("source").applyInPandas(fill, columns.drop("open").schema)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """``(id, row_hash, source, size, source_size, target, taken, repeats, n)``, one row per distinct input row.

    Size: words ``[^\\x20\\x09-\\x0D]+`` (null: 0). ``n`` is how often the same id, source and text came; ``taken``
    and ``repeats`` (copies of the document in the mix) are of all ``n`` together. Null ids and sources are
    values like others; texts of no words are taken zero times. The same rows give the same mix. No document
    is taken more than ``most`` times; taken words are as near to the target as documents of the lengths that
    are still open allow, above it too.
    """
    words = F.size(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), " "))
    size = F.when(F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]"), words).otherwise(0).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("row_hash"))
    rows = stored(rows.groupBy("id", "source", "size", "row_hash").agg(F.count(F.lit(1)).alias("n")), "mix_rows")
    lengths = stored(rows.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix_lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most), "mix_targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = stored(_plan(lengths.join(targets, same(lengths, targets)).select(lengths["*"], "source_size", "target")), "mix_plan")
    # seeded order within a length: about sqrt(n) bins; bins before the last take all, only that one is ranked
    placed = rows.withColumn("order", F.xxhash64("id", "row_hash", F.lit(seed)))
    per = plan.withColumn("bins", F.ceil(F.sqrt("n")).cast("long")).select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "bins", "passes", "whole")
    placed = placed.join(per, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    placed = placed.withColumn("bin", F.pmod("order", "bins"))
    bins = placed.groupBy("source", "size", "bin").agg(F.sum("n").alias("in_bin"))
    upto = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(upto), F.lit(0))).withColumnsRenamed({"source": "b_source", "size": "b_size", "bin": "b_bin"})
    placed = placed.join(bins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bin") == F.col("b_bin")))
    edge = (F.col("before") < F.col("whole")) & (F.col("before") + F.col("in_bin") > F.col("whole"))
    ranked = Window.partitionBy("source", "size", "bin").orderBy("order", "id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    plain = placed.filter(~edge).withColumn("extra", F.when(F.col("before") < F.col("whole"), F.col("n")).otherwise(0))
    last = placed.filter(edge).withColumn("earlier", F.col("before") + F.coalesce(F.sum("n").over(ranked), F.lit(0)))
    last = last.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), F.col("whole") - F.col("earlier")))).drop("earlier")
    chosen = plain.unionByName(last).withColumn("repeats", F.col("passes") * F.col("n") + F.col("extra"))
    goal = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    chosen = chosen.join(F.broadcast(goal) if targets.count() <= 10_000 else goal, F.col("source").eqNullSafe(F.col("t_source")))
    return chosen.select(
        F.col("id").alias(id_col), "row_hash", F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "n", "passes", "extra",
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``; equal rows follow each other in taking."""
    one = mix(docs, **options).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    taken = F.col("size") * (F.col("passes") + (F.col("copy") <= F.col("extra")).cast("long"))
    return one.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself in the columns of ``docs``: a row as often as it is taken, rows not taken are left out.

    The repeats of rows that are equal in id, source and text are dealt to one of them. Texts without words are not in
    the mix. Null ids and sources are values like others; an empty table has an empty mix.
    """
    key = fresh(docs, "row_key")
    of = lambda i, t: F.concat_ws(":", F.hex(F.xxhash64(i, t)), F.hex(t))
    chosen = mix(docs, id_col, source_col, text_col, **options).filter("repeats > 0 AND size > 0")
    source = F.xxhash64(F.col(source_col), F.lit(1))
    takes = chosen.select(F.concat_ws(":", of(F.col(id_col), F.col("row_hash")), F.hex(source)).alias(key), F.col("repeats").alias(fresh(docs, "repeats")))
    repeats = takes.columns[1]
    keyed = docs.withColumn(key, F.concat_ws(":", of(F.col(id_col), F.xxhash64(text_col)), F.hex(source)))
    taken = keyed.join(takes, key).dropDuplicates([key])
    return taken.withColumn(repeats, F.explode(F.sequence(F.lit(1).cast("long"), F.col(repeats)))).select(*docs.columns)
