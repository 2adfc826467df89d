"""Carry within groups, with nulls in keys and buckets."""

from pyspark.sql import functions as F

from lorespan.functions import carry

ROWS = [(None, 1, None, 5), (None, 2, 1, 7), (None, 3, 2, 1), ("a", 1, 1, 2), ("a", 2, 1, 3), ("a", 3, None, 4), ("b", 1, 1, None)]


def test_null_keys_and_buckets(spark):
    df = spark.createDataFrame(ROWS, "session string, id int, day int, v int")
    got = carry.running_sum(df, ["session"], ["day", "id"], F.col("day"), {"total": F.col("v")})
    want, totals = [], {}
    for s, i, d, v in sorted(ROWS, key=lambda r: (r[0] or "", r[2] or 0, r[1])):
        totals[s] = totals.get(s, 0) + (v or 0)
        want.append((s, i, totals[s]))
    assert sorted(((r.session or "", r.id, r.total) for r in got.collect())) == sorted((s or "", i, t) for s, i, t in want)
    last = carry.last_before(df, ["session"], ["day", "id"], F.col("day"), {"before": F.col("v")})
    assert {(r.session, r.id): r.before for r in last.collect()} == {
        (None, 1): None, (None, 2): 5, (None, 3): 7, ("a", 3): None, ("a", 1): 4, ("a", 2): 2, ("b", 1): None,
    }
