"""Carry helpers against plain windows, re-read states, deltas."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import carry
from lorespan.operators import economy, ledger


def test_carry_equals_window_on_a_hot_group(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 7).alias("g"), "id",
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"), (F.col("id") % 11).alias("x"),
    )
    bucket = F.floor(F.col("id") / 100)
    w = W.partitionBy("g").orderBy("id")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(carry.running_sum(df, ["g"], ["id"], bucket, {"s": F.col("x")}).select("g", "id", "s")) == key(
        df.select("g", "id", F.sum("x").over(upto))
    )
    assert key(carry.row_numbers(df, ["g"], ["id"], bucket, "n").select("g", "id", "n")) == key(df.select("g", "id", F.row_number().over(w)))
    got = carry.last_before(df, ["g"], ["id"], bucket, {"l": F.col("v")}).select("g", "id", F.coalesce("l", F.lit(-1)))
    assert key(got) == key(df.select("g", "id", F.coalesce(F.last("v", True).over(before), F.lit(-1))))


READS = [  # session, file, turn, hash, state, ref
    ("s", "f", 1, "A", "full", None),
    ("s", "g", 2, "A", "full", None),
    ("s", "f", 3, "B", "changed", 1),
    ("s", "f", 4, "B", "unchanged", 3),
    ("s", "f", 5, None, "missing", None),
    ("s", "f", 6, "B", "unchanged", 3),
    ("s", "f", 7, "A", "changed", 3),
    ("t", "f", 1, None, "missing", None),
    ("t", "f", 2, "A", "full", None),
]


def test_read_states(spark):
    df = spark.createDataFrame([r[:4] for r in READS], "session string, file string, turn bigint, hash string")
    for size in (1, 3, 100):
        out = ledger.read_states(df, "session", F.floor(F.col("turn") / size))
        assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame(READS, out.schema).collect()))


def session_brute(rows):
    """Turn, state and reference turn, read by read."""
    out, turns, seen = [], {}, {}
    for s, at, f, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        turn = turns[s] = turns.get(s, 0) + 1
        last, ref = seen.get((s, f), (None, None))
        state = "missing" if h is None else "full" if last is None else "unchanged" if h == last else "changed"
        out.append((s, at, f, h, turn, state, ref if state in ("unchanged", "changed") else None))
        if state in ("full", "changed"):
            seen[s, f] = h, turn
    return sorted(out, key=repr)


def test_session_reads_of_one_hot_day(spark):
    """A session of most rows, all on one day, lies on several stretches and is read as a whole."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), n, rng.choice("fgh") + str(rng.randrange(9)), rng.choice(["A", "B", "B", None])) for n in range(6000)]
    df = spark.createDataFrame(rows, "session string, at bigint, file string, hash string").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = carry.in_places(df, ["session"], ["at"])
        sizes = [r["count"] for r in placed.filter("session = 'hot'").groupBy(carry.PART).count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 2000
        found = ledger.session_reads(df, "session", ["at"])
        assert found.columns == [*df.columns, "turn", "state", "ref_turn"]
        assert sorted(map(tuple, found.collect()), key=repr) == session_brute(rows)
        saved = df.select("session", "at", F.length("file").cast("bigint").alias("saved"))
        running = {(r.session, r.at): r.session_saved for r in economy.session_running_saved(saved, "session", ["at"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = {}
    for s, at, f, _ in sorted(rows, key=lambda r: r[1]):
        sums[s] = sums.get(s, 0) + len(f)
        assert running[s, at] == sums[s]
    assert ledger.session_reads(df.limit(0), "session", ["at"]).collect() == []


def delta(spark, pairs):
    df = spark.createDataFrame(pairs, "k int, old string, new string")
    return ledger.line_delta(df, "k", "old", "new").collect()


def test_line_delta_with_repeats(spark):
    got = delta(spark, [(1, "a\na\nb\n", "a\nb\nc\nb\n"), (2, "same\n", "same\n")])
    assert sorted((r.k, r.side, r.line, r.text) for r in got) == [(1, "added", 2, "b"), (1, "added", 3, "c"), (1, "removed", 2, "a")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8)), min_size=5, max_size=20))
def test_delta_reapplies(spark, pairs):
    """Old lines less the removed plus the added are the new lines."""
    texts = [(i, "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)) for i, (a, b) in enumerate(pairs)]
    got = delta(spark, texts)
    for i, (a, b) in enumerate(pairs):
        gone = {r.line for r in got if r.k == i and r.side == "removed"}
        new = {r.line: r.text for r in got if r.k == i and r.side == "added"}
        kept = [x for n, x in enumerate(a, 1) if n not in gone]
        assert kept == [x for n, x in enumerate(b, 1) if n not in new]
        assert all(b[n - 1] == t for n, t in new.items())


def test_sent_text(spark):
    new = "a\nb\nc\nD\ne\nf\n"
    states = spark.createDataFrame([("missing",), ("full",), ("unchanged",), ("changed",)], "s string")
    sent = [r.t for r in states.select(ledger.sent_text(F.col("s"), F.lit("f.py"), F.lit(4), F.lit(new), F.lit("D")).alias("t")).collect()]
    assert sent == ["[ERROR: f.py not found]", new, "[f.py: unchanged since turn 4]", "[f.py: changed since turn 4]\nD"]
