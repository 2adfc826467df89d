"""Re-read ledger: what a session has seen of a file, and what a new read has to send."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.functions import align, carry, text
from lorespan.functions.text import token_estimate
from lorespan.session import stored


def turns(reads: DataFrame, session: str, order: list[str], bucket: Column) -> DataFrame:
    """Numbers the reads of a session from 1 over all its files."""
    return carry.row_numbers(reads, [session], order, bucket, "turn")


def read_states(reads: DataFrame, session: str, bucket: Column, file: str = "file", digest: str = "hash", turn: str = "turn") -> DataFrame:
    """State of each read (missing, full, unchanged, changed) and the turn it refers to.

    A null digest is a file that could not be read; it leaves the state as it was. The reference turn
    is that of the first read or of the last change before this read.
    """
    keys = [session, file]
    seen = carry.last_before(reads, keys, [turn], bucket, {"_prev": F.col(digest)})
    state = (
        F.when(F.col(digest).isNull(), F.lit("missing"))
        .when(F.col("_prev").isNull(), F.lit("full"))
        .when(F.col(digest) == F.col("_prev"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    marked = seen.withColumn("state", state)
    moved = F.when(F.col("state").isin("full", "changed"), F.col(turn))
    out = carry.last_before(marked, keys, [turn], bucket, {"_ref": moved})
    return out.select(
        *reads.columns,
        "state",
        F.when(F.col("state").isin("unchanged", "changed"), F.col("_ref")).alias("ref_turn"),
    )


def session_reads(reads: DataFrame, session: str, order: list[str], file: str = "file", digest: str = "hash") -> DataFrame:
    """``reads`` with turn, state and reference turn: ``turns`` and ``read_states`` in one scan of the reads.

    Rows are sorted by session and order and cut into stretches of equal size (``carry.in_places``). Within a stretch
    windows number the rows and compare each read with the one before it. What a stretch hands on to the next of its
    session is a number of rows per session, and per file the last digest and the turn of its last change; only sessions
    that lie on several stretches, at most one per border, have any.
    """
    part, place = carry.PART, carry.PLACE
    rows = carry.in_places(reads, [session], order, "reads")
    ends = rows.groupBy(part, session).agg(F.count(F.lit(1)).alias("_n"))
    several = ends.groupBy(session).agg(F.count(F.lit(1)).alias("_parts")).filter("_parts > 1").select(F.col(session).alias("_spread"))
    earlier = lambda *keys: W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = ends.join(several, F.col(session).eqNullSafe(F.col("_spread"))).select(part, session, F.sum("_n").over(earlier(session)).alias("_before"))
    cut = rows.join(several, F.col(session).eqNullSafe(F.col("_spread"))).drop("_spread")
    known = cut.groupBy(part, session, file).agg(F.max_by(digest, F.when(F.col(digest).isNotNull(), F.col(place))).alias("_last"))
    handed = known.select(part, session, file, F.last("_last", ignorenulls=True).over(earlier(session, file)).alias("_handed"))

    stretch = W.partitionBy(part, session).orderBy(place)
    above = W.partitionBy(part, session, file).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("_turn", F.row_number().over(stretch)).withColumn("_seen", F.last(digest, ignorenulls=True).over(above))
    numbered = _handed_on(_handed_on(numbered, before, [part, session]), handed, [part, session, file])
    prev = F.coalesce("_seen", "_handed")
    state = (
        F.when(F.col(digest).isNull(), F.lit("missing")).when(prev.isNull(), F.lit("full"))
        .when(F.col(digest) == prev, F.lit("unchanged")).otherwise(F.lit("changed"))
    )
    told = numbered.withColumn("turn", (F.col("_turn") + F.coalesce("_before", F.lit(0))).cast("bigint")).withColumn("state", state)
    moved = F.when(F.col("state").isin("full", "changed"), F.col("turn"))
    told = stored(told.select(*reads.columns, "turn", "state", moved.alias("_moved"), place, part), "read_states")
    moves = told.join(several, F.col(session).eqNullSafe(F.col("_spread"))).groupBy(part, session, file).agg(F.max("_moved").alias("_at"))
    since = moves.select(part, session, file, F.max("_at").over(earlier(session, file)).alias("_since"))
    out = _handed_on(told.withColumn("_ref", F.max("_moved").over(above)), since, [part, session, file])
    return out.select(*reads.columns, "turn", "state", F.when(F.col("state").isin("unchanged", "changed"), F.coalesce("_ref", "_since")).alias("ref_turn"))


def _handed_on(rows: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that takes null keys for equal."""
    named = earlier.withColumnsRenamed({c: f"_k{c}" for c in keys})
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in keys], "left").drop(*(f"_k{c}" for c in keys))


#: Unchanged lines shown around a change.
AROUND = 3
_BLOCK = ("a1", "a2", "b1", "b2")


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in _BLOCK])))
def _changed_blocks(old: pa.Array, new: pa.Array) -> pa.Array:
    out = [[dict(zip(_BLOCK, x, strict=True)) for x in align.changed_blocks(a.as_py(), b.as_py())] for a, b in zip(old, new, strict=True)]
    return pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in _BLOCK])))


def _part(array: Column, start: Column, end: Column) -> Column:
    """Elements from ``start`` to before ``end``, numbered from 0."""
    return F.slice(array, start + 1, end - start)


def _unchanged(lines: Column, blocks: Column, start: str, end: str) -> Column:
    """The lines outside all blocks."""
    ends = F.concat(F.array(F.lit(0)), F.transform(blocks, lambda x: x[end]))
    starts = F.concat(F.transform(blocks, lambda x: x[start]), F.array(F.size(lines)))
    return F.flatten(F.zip_with(ends, starts, lambda i, j: _part(lines, i, j)))


def aligned(pairs: DataFrame, key: str, old: str, new: str, *more: Column) -> DataFrame:
    """``(key, a, b, blocks)`` and ``more`` of changed pairs: the lines of both versions with their breaks, and the
    stretches that changed, in order (``functions.align``).

    A pair is one row, as large as two indexable files, so nothing is shuffled. Lines are aligned by 64-bit hashes; if
    hashes of different lines were equal, the whole old version would be replaced.
    """
    split = pairs.filter(F.col(old) != F.col(new)).select(F.col(key), text.lines_with_ends(F.col(old)).alias("a"), text.lines_with_ends(F.col(new)).alias("b"), *more)
    found = split.withColumn("blocks", _changed_blocks(F.transform("a", lambda x: F.xxhash64(x)), F.transform("b", lambda x: F.xxhash64(x))))
    holds = _unchanged(F.col("a"), F.col("blocks"), "a1", "a2") == _unchanged(F.col("b"), F.col("blocks"), "b1", "b2")
    whole = F.array(F.struct(F.lit(0).alias("a1"), F.size("a").alias("a2"), F.lit(0).alias("b1"), F.size("b").alias("b2")))
    return found.withColumn("blocks", F.when(holds, F.col("blocks")).otherwise(whole))


def line_delta(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Lines removed and added between two versions, with their line numbers and without their breaks."""

    def rows(side: str, lines: str, start: str, end: str) -> Column:
        of_block = lambda x: F.transform(_part(F.col(lines), x[start], x[end]), lambda t, n: F.struct(F.lit(side).alias("side"), (x[start] + n + 1).alias("line"), t.alias("text")))
        return F.flatten(F.transform("blocks", of_block))

    found = aligned(pairs, key, old, new).select(key, F.inline(F.concat(rows("removed", "a", "a1", "a2"), rows("added", "b", "b1", "b2"))))
    return found.withColumn("text", F.regexp_replace("text", f"(?:{text.LINE_BREAK})\\z", ""))


def _range(start: Column, end: Column) -> Column:
    """Line numbers of a hunk: the first and, unless it is 1, the number of lines; for none the line before."""
    n = end - start
    first = F.when(n == 0, start).otherwise(start + 1).cast("string")
    return F.when(n == 1, first).otherwise(F.concat(first, F.lit(","), n.cast("string")))


def _marked(mark: str, lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda t: F.concat(F.lit(mark), t)), "")


def _hunk(blocks: Column, a: Column, b: Column) -> Column:
    """One hunk: head, and its blocks with unchanged lines before each and after the last."""
    first, last = F.element_at(blocks, 1), F.element_at(blocks, -1)
    before = F.least(F.lit(AROUND), first["a1"])
    after = F.least(F.lit(AROUND), F.size(a) - last["a2"])
    head = F.concat(F.lit("@@ -"), _range(first["a1"] - before, last["a2"] + after), F.lit(" +"), _range(first["b1"] - before, last["b2"] + after), F.lit(" @@\n"))
    shown_from = F.concat(F.array(first["a1"] - before), F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda x: x["a2"]))
    bodies = F.zip_with(blocks, shown_from, lambda x, i: F.concat(_marked(" ", _part(a, i, x["a1"])), _marked("-", _part(a, x["a1"], x["a2"])), _marked("+", _part(b, x["b1"], x["b2"]))))
    return F.concat(head, F.array_join(bodies, ""), _marked(" ", _part(a, last["a2"], last["a2"] + after)))


def unified_delta(pairs: DataFrame, key: str, old: str, new: str, label: Column, turn: Column) -> DataFrame:
    """``(key, delta)`` for each changed pair: a unified diff with three unchanged lines around each change.

    Changes with up to six unchanged lines between them share a hunk. A last line without a line break is printed
    without one.
    """
    gap = 2 * AROUND
    blocks = F.col("blocks")
    apart = lambda n: F.get(blocks, n)["a1"] - F.get(blocks, n - 1)["a2"] > gap
    firsts = F.filter(F.sequence(F.lit(0), F.size(blocks) - 1), lambda n: (n == 0) | apart(n))
    nexts = F.concat(F.slice(F.col("firsts"), 2, F.size("firsts")), F.array(F.size(blocks)))
    hunks = F.zip_with("firsts", "nexts", lambda i, j: _hunk(_part(blocks, i, j), F.col("a"), F.col("b")))
    head = F.format_string("--- %s (turn %d)\n+++ %s (current)\n", label, turn, label).alias("head")
    found = aligned(pairs, key, old, new, head).withColumn("firsts", firsts).withColumn("nexts", nexts)
    return found.select(key, F.concat("head", F.array_join(hunks, "")).alias("delta"))


# The notices that a read gets instead of a file.
def sent_text(state: Column, file: Column, ref_turn: Column, content: Column, delta: Column, error: Column | None = None) -> Column:
    """Text a read sends: whole file, notice, or notice and delta. ``error`` tells why a file that is there could not be
    read; it is null for all others."""
    missing = F.concat(F.lit("[ERROR: "), file, F.lit(" not found]"))
    if error is not None:
        missing = F.when(error.isNotNull(), F.concat(F.lit("[ERROR: cannot read "), file, F.lit(": "), error, F.lit("]"))).otherwise(missing)
    return (
        F.when(state == "missing", missing)
        .when(state == "full", content)
        .when(state == "unchanged", F.format_string("[%s: unchanged since turn %d]", file, ref_turn))
        .otherwise(F.concat(F.format_string("[%s: changed since turn %d]\n", file, ref_turn), delta))
    )


def sent_tokens(state: Column, file: Column, ref_turn: Column, content: Column, delta: Column, error: Column | None = None) -> Column:
    return token_estimate(sent_text(state, file, ref_turn, content, delta, error))
