"""Ordered deltas: alignment, hunks with context, against hand-written pairs and the standard library."""

import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from lorespan.functions import align
from lorespan.operators import ledger


def unified(spark, pairs):
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "k int, old string, new string")
    rows = ledger.unified_delta(df, "k", "old", "new", F.lit("f.py"), F.lit(4)).collect()
    return {r.k: r.delta for r in rows}


HEAD = "--- f.py (turn 4)\n+++ f.py (current)\n"
NUMBERS = [f"line {n}\n" for n in range(1, 41)]


def changed(lines, **at):
    return "".join(at.get(f"n{n}", line) for n, line in enumerate(lines, 1))


HAND = [
    # one line replaced, three lines around
    ("a\nb\nc\nd\ne\nf\ng\nh\n", "a\nb\nc\nd\nE\nf\ng\nh\n", "@@ -2,7 +2,7 @@\n b\n c\n d\n-e\n+E\n f\n g\n h\n"),
    # a block moved to the end is reported on both sides
    ("x1\nx2\na\nb\nc\nd\n", "a\nb\nc\nd\nx1\nx2\n", "@@ -1,6 +1,6 @@\n-x1\n-x2\n a\n b\n c\n d\n+x1\n+x2\n"),
    # two lines swapped
    ("a\nb\n", "b\na\n", "@@ -1,2 +1,2 @@\n-a\n b\n+a\n"),
    # six unchanged lines between changes: one hunk
    ("".join(NUMBERS[:12]), changed(NUMBERS[:12], n2="B\n", n9="I\n"), "@@ -1,12 +1,12 @@\n line 1\n-line 2\n+B\n" + "".join(f" line {n}\n" for n in range(3, 9)) + "-line 9\n+I\n line 10\n line 11\n line 12\n"),
    # seven: two hunks
    ("".join(NUMBERS[:14]), changed(NUMBERS[:14], n2="B\n", n10="J\n"), "@@ -1,5 +1,5 @@\n line 1\n-line 2\n+B\n line 3\n line 4\n line 5\n@@ -7,7 +7,7 @@\n line 7\n line 8\n line 9\n-line 10\n+J\n line 11\n line 12\n line 13\n"),
    # the last line loses its break
    ("a\n", "a", "@@ -1 +1 @@\n-a\n+a"),
    ("", "a\nb\n", "@@ -0,0 +1,2 @@\n+a\n+b\n"),
    ("a\nb\n", "", "@@ -1,2 +0,0 @@\n-a\n-b\n"),
    ("", "one", "@@ -0,0 +1 @@\n+one"),
    # other line breaks than \n end lines too
    ("a\r\nb\x0bc d", "a\r\nB\x0bc d", "@@ -1,4 +1,4 @@\n a\r\n-b\x0b+B\x0b c  d"),
]


def test_hand_written_pairs(spark):
    got = unified(spark, [(a, b) for a, b, _ in HAND])
    for n, (a, b, body) in enumerate(HAND):
        assert got[n] == HEAD + body, (a, b)


def test_equals_the_standard_library_where_the_alignment_is_clear(spark):
    """Files of distinct lines, edited in place: only one alignment keeps the most lines."""
    rng = random.Random(11)
    pairs = []
    for _ in range(60):
        old = [f"{n} {rng.random()}\n" for n in range(rng.randrange(0, 60))]
        new = [x for line in old for x in ([line] if rng.random() < 0.85 else rng.choice([[], [f"new {rng.random()}\n"], [line, f"more {rng.random()}\n"]]))]
        if old != new:
            pairs.append(("".join(old), "".join(new)))
    got = unified(spark, pairs)
    for n, (a, b) in enumerate(pairs):
        want = difflib.unified_diff(a.splitlines(True), b.splitlines(True), "f.py (turn 4)", "f.py (current)", n=3)
        assert got[n] == "".join(want)


def applied(old, delta):
    """The new version by the hunks of a delta, checked line by line."""
    lines, out, at = old.splitlines(True), [], 0
    for hunk in delta[len(HEAD):].split("@@ -")[1:]:
        head, body = hunk.split(" @@\n", 1)
        start, n = [int(x) for x in (*head.split(" +")[0].split(","), 1)[:2]]
        first = start - 1 if n else start
        out += lines[at:first]
        at = first
        for line in body.splitlines(True):
            if line[0] != "+":
                assert lines[at] == line[1:]
                at += 1
            if line[0] != "-":
                out.append(line[1:])
    return "".join([*out, *lines[at:]])


def test_hunks_reapply_to_any_pair(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(150):
        old = [rng.choice("abcd") + "\n" for _ in range(rng.randrange(0, 30))]
        new = [rng.choice("abcd") + "\n" if rng.random() < 0.2 else x for x in old if rng.random() < 0.9]
        rng.shuffle(new) if rng.random() < 0.2 else None
        pairs.append(("".join(old), "".join(new)))
    got = unified(spark, pairs)
    for n, (a, b) in enumerate(pairs):
        assert (applied(a, got[n]) if a != b else a) == b


@pytest.mark.parametrize("kind", ["distinct", "few", "shuffled", "reversed", "same"])
def test_matches_rise_and_are_equal(kind):
    rng = random.Random(2)
    for _ in range(30):
        a = [rng.randrange(1000 if kind == "distinct" else 5) for _ in range(rng.randrange(0, 80))]
        b = {"distinct": [x for x in a if rng.random() < 0.8], "few": [rng.randrange(5) for _ in a], "shuffled": rng.sample(a, len(a)), "reversed": a[::-1], "same": a}[kind]
        found = align.matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        if kind in ("same", "distinct") and len(set(a)) == len(a):
            assert len(found) == len(b)


def test_long_files_take_seconds(spark):
    rng = random.Random(1)
    old = [f"value {rng.randrange(3000)}\n" if n % 2 else f"row {n}\n" for n in range(20_000)]
    new = [x if rng.random() < 0.97 else f"edit {rng.random()}\n" for x in old[5000:] + old[:5000]]
    same = ["x\n"] * 20_000
    start = time.perf_counter()
    got = unified(spark, [("".join(old), "".join(new)), ("".join(same), "".join(same[:15_000] + ["y\n"] + same[:4_000]))])
    assert time.perf_counter() - start < 20
    assert applied("".join(old), got[0]) == "".join(new)
    assert applied("".join(same), got[1]).count("\n") == 19_001


def test_equal_hashes_of_different_lines_replace_everything(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda x: F.lit(1).cast("long"))
    assert unified(spark, [("a\nb\n", "a\nc\n")])[0] == HEAD + "@@ -1,2 +1,2 @@\n-a\n-b\n+a\n+c\n"


def test_unreadable_files(spark):
    df = spark.createDataFrame([("missing", None), ("missing", "denied")], "s string, e string")
    got = [r.t for r in df.select(ledger.sent_text(F.col("s"), F.lit("f.py"), F.lit(4), F.lit("x"), F.lit("D"), F.col("e")).alias("t")).collect()]
    assert got == ["[ERROR: f.py not found]", "[ERROR: cannot read f.py: denied]"]
