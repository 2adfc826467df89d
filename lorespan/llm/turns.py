"""Conversation rows in one order over the whole table, stored once.

Rows are range-partitioned by conversation and turn and sorted, so a conversation that holds a third of all
rows is spread over partitions. ``place`` numbers the stored rows: it grows along the order and is consecutive
within a partition. Rows of equal conversation and turn follow role and text (their first ``TIE`` code points,
then the SHA-256 of both); rows equal in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import stored

#: Code points of role and text that tied turns are ordered by before their digest; sort keys stay short.
TIE = 64


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; the length in front keeps two splits of one string apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def in_order(rows: DataFrame, group: str, name: str) -> DataFrame:
    """``rows`` of ``group``, ``turn``, ``role`` and ``text`` (neither null) and further columns, stored with
    ``key`` (their digest) and ``place``."""
    keyed = rows.withColumns({"key": digest(F.col("role"), F.col("text")), "_row": F.monotonically_increasing_id()})
    order = [F.col(group).asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, TIE).asc(), F.substring("text", 1, TIE).asc(), F.col("key").asc(), F.col("_row").asc()]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.select(F.monotonically_increasing_id().alias("place"), *rows.columns, "key"), name)
