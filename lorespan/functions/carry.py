"""Ordered carry within a group: running sums, row numbers and last-seen values.

A plain window puts a whole group in one task. Here each group is cut into buckets that follow
the order (a day, an hour, a block of sequence numbers). The window runs per (group, bucket), one
small row per bucket is carried forward, and the two are added. A group that holds a third of all
rows is then spread over as many tasks as it has buckets, and the rows are shuffled once. Null keys
are a group and a null bucket comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.session import stored

BUCKET = "_bucket"
PLACE, PART = "_place", "_part"


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on group and bucket that takes nulls for equal."""
    named = carry.withColumnsRenamed({c: f"_k_{c}" for c in (*keys, BUCKET)})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, BUCKET)]
    return rows.join(named, same, "left").drop(*(f"_k_{c}" for c in (*keys, BUCKET)))


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """Adds one inclusive running sum per entry of ``sums``."""
    df = df.withColumn(BUCKET, bucket)
    within = W.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = df.select("*", *[F.sum(v).over(within).alias(f"_in_{n}") for n, v in sums.items()])
    totals = df.groupBy(*keys, BUCKET).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    across = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    joined = _with_carry(inner, carry, keys)
    return joined.select(
        *[c for c in df.columns if c != BUCKET],
        *[(F.coalesce(F.col(f"_in_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    return running_sum(df, keys, order, bucket, {name: F.lit(1).cast("bigint")})


def last_before(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, Column]) -> DataFrame:
    """Adds, per entry, the last non-null value on an earlier row of the group.

    Wrap a value in a struct to let it be null and still count as seen. ``order`` must be total.
    """
    df = df.withColumn(BUCKET, bucket).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    within = W.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = df.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(within).alias(f"_in_{n}") for n in values])
    at = F.struct(*order)
    ends = df.groupBy(*keys, BUCKET).agg(
        *[
            F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_e_{n}")
            for n in values
        ]
    )
    across = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*keys, BUCKET, *[F.last(f"_e_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values])
    joined = _with_carry(inner, carry, keys)
    keep = [c for c in df.columns if c != BUCKET and not c.startswith("_v_")]
    return joined.select(*keep, *[F.coalesce(f"_in_{n}", f"_c_{n}").alias(n) for n in values])


def in_places(df: DataFrame, keys: list[str], order: list[str], name: str = "places") -> DataFrame:
    """The rows sorted by keys and order over the whole table, written once, with ``PLACE`` and ``PART``.

    ``PART`` numbers stretches of rows of about equal size: it follows the order, so it can be the bucket of the functions
    above, and it cuts any group, even one whose rows all fall on one day. Rows equal in keys and order stay apart too.
    """
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    columns = [F.col(c).asc_nulls_first() for c in (*keys, *order, "_tie")]
    placed = tie.repartitionByRange(*columns).sortWithinPartitions(*columns).select(*df.columns, F.monotonically_increasing_id().alias(PLACE))
    return stored(placed, name).withColumn(PART, F.shiftright(PLACE, 33))
