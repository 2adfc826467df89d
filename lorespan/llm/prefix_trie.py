"""Trie of conversation prefixes, told apart by composable fingerprints.

A sequence of turns x1..xn has the fingerprint ``sum of xi * R^i`` in two lanes modulo 2^61 - 1. Such sums form
a monoid, (n, u) * (m, v) = (n + m, u + R^n * v), and every element can be taken off again. A conversation
rebuilt from the head of its base and its own remaining turns therefore gets the fingerprints of all its
prefixes from the stored sums of both, by one product a turn; rebuilt texts exist nowhere. The same law joins the
parts of a conversation that is spread over partitions.

Prefixes of equal depth and fingerprint are a node. Its members must agree on the parent's fingerprint and on the
last turn, known by a reference to the stored row: members that share the reference need no look at texts, others
have their texts compared. If any node fails, everything is done again with another R.

A conversation is the smallest member of its nodes from some depth on. So sums over a subtree come from one row per
conversation and depth: each leaf and each saving belongs to a smallest member, and is added to all its prefixes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm.common import stored
from lorespan.llm.turns import in_order

#: A conversation takes fewer than this many turns from its base; every this-many-th conversation is a base.
HEADS, BASES = 6, 100
PRIME = (1 << 61) - 1
#: Depths that are summed up together before the sums are carried on.
BLOCK = 1024
#: Ids that are joined to one string at a time.
IDS = 4096
NODE = ["depth", "f1", "f2"]
SUMS = ["n", "v1", "v2", "u1", "u2", "chars"]


def multipliers(attempt: int) -> tuple[int, int]:
    """R of both lanes for each attempt, drawn by a digest."""
    words = hashlib.sha256(f"prefix trie {attempt}".encode()).digest()
    return tuple(int.from_bytes(words[8 * n : 8 * n + 8], "big") % (PRIME - 3) + 2 for n in (0, 1))


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _longs(names: list[str]) -> str:
    return ", ".join(f"{c} long" for c in names)


def _local_sums(turns: DataFrame, rates: tuple[int, int]) -> DataFrame:
    """Number and fingerprint of each turn within its run, before (v) and with it (u).

    A run is what one task reads of a conversation without a gap between places; its first place names it.
    """
    r1, r2 = rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, first, n, u1, u2, w1, w2 = None, None, 0, 0, 0, 0, 1, 1
        for batch in batches:
            out = [[] for _ in range(6)]
            for place, conv, key in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if conv != now or place != last + 1:
                    now, first, n, u1, u2, w1, w2 = conv, place, 0, 0, 0, 1, 1
                last, n, w1, w2 = place, n + 1, w1 * r1 % PRIME, w2 * r2 % PRIME
                v1, v2 = u1, u2
                u1 = (u1 + int.from_bytes(key[:8], "big") * w1) % PRIME
                u2 = (u2 + int.from_bytes(key[8:16], "big") * w2) % PRIME
                for column, x in zip(out, (first, n, v1, v2, u1, u2), strict=True):
                    column.append(x)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in out), batch.column(3)], names=["place", "conv_id", "run", *SUMS])

    read = turns.select("place", "conv_id", "key", F.length("text").cast("long").alias("chars")).sortWithinPartitions("place")
    return read.mapInArrow(run, f"place long, conv_id long, run long, {_longs(SUMS)}")


def _before(local: DataFrame, rates: tuple[int, int]) -> DataFrame:
    """Turns and fingerprint before each run of a conversation that has several; at most a row per reading task."""

    def fold(group: pa.Table) -> pa.Table:
        n, u, out = 0, (0, 0), []
        for r in sorted(group.to_pylist(), key=lambda r: r["run"]):
            out.append((r["run"], n, *u))
            u = tuple((a + pow(rate, n, PRIME) * b) % PRIME for a, b, rate in zip(u, (r["u1"], r["u2"]), rates, strict=True))
            n += r["n"]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["run", "n_before", "b1", "b2"])

    runs = local.groupBy("run").agg(F.min("conv_id").alias("conv_id"), F.max("n").alias("n"))
    several = runs.groupBy("conv_id").count().filter("count > 1").select("conv_id")
    ends = F.broadcast(runs.join(several, "conv_id").select("run", "n"))
    return local.join(ends, ["run", "n"]).select("conv_id", "run", "n", "u1", "u2").groupBy("conv_id").applyInArrow(fold, "run long, n_before long, b1 long, b2 long")


def _sums(turns: DataFrame, rates: tuple[int, int]) -> DataFrame:
    """Position and fingerprints of each turn within its whole conversation."""
    local = stored(_local_sums(turns, rates), "trie_local")
    before = stored(_before(local, rates), "trie_before")
    names = ["place", "conv_id", *SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for place, conv, n, v1, v2, u1, u2, chars, first, b1, b2 in zip(*(batch.column(c).to_pylist() for c in (*names, "n_before", "b1", "b2")), strict=True):
                if first:
                    w1, w2 = (pow(rate, first, PRIME) for rate in rates)
                    n, v1, v2, u1, u2 = n + first, (b1 + w1 * v1) % PRIME, (b2 + w2 * v2) % PRIME, (b1 + w1 * u1) % PRIME, (b2 + w2 * u2) % PRIME
                for column, x in zip(out, (place, conv, n, v1, v2, u1, u2, chars), strict=True):
                    column.append(x)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=names)

    return stored(local.join(F.broadcast(before), "run", "left").mapInArrow(run, _longs(names)), "trie_sums")


def _members(sums: DataFrame, rates: tuple[int, int]) -> DataFrame:
    """A row per rebuilt conversation and depth: fingerprint, the parent's, the last turn's place and code points."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    heads = sums.filter(F.col("n") < HEADS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "v1", "v2", "u1", "u2", "place", "chars"))).alias("head"))
    bases = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    h = head_length(F.col("conv_id"))
    known = sums.groupBy("conv_id").agg(F.max("n").alias("own")).join(heads, "conv_id").withColumn("base", F.col("conv_id") - F.col("conv_id") % BASES).join(bases, "base", "left")
    taken = F.slice(F.coalesce("base_head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), h)
    known = known.select("conv_id", h.alias("h"), "own", "head", taken.alias("taken")).withColumn("k", F.size("taken"))
    # t: what the base's head comes to; o: what the own head comes to, which is taken off
    ends = {"t": F.try_element_at("taken", F.lit(-1)), "o": F.when(F.col("h") > 0, F.try_element_at("head", F.greatest(F.col("h"), F.lit(1))))}
    known = known.withColumns({"length": F.col("k") + F.greatest(F.col("own") - F.col("h"), zero)} | {f"{c}{x}": F.coalesce(end[f"u{x}"], zero) for c, end in ends.items() for x in "12"})
    known = stored(known.drop("head"), "trie_conversations")
    root = known.select("conv_id", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), none.alias("p1"), none.alias("p2"), none.alias("ref"), zero.alias("chars"), (F.col("length") == 0).alias("ends"))
    first = known.select("conv_id", "length", F.explode("taken").alias("t")).select("conv_id", *(F.col(f"t.{a}").alias(b) for a, b in (("n", "depth"), ("u1", "f1"), ("u2", "f2"), ("v1", "p1"), ("v2", "p2"), ("place", "ref"), ("chars", "chars"))), (F.col("t.n") == F.col("length")).alias("ends"))
    rest = known.filter(F.col("own") > F.col("h")).select("conv_id", "h", "k", "length", "t1", "t2", "o1", "o2")
    own = sums.join(rest, "conv_id").filter(F.col("n") > F.col("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # own turns move by k - h places, as the base's head replaces the own one
        shift = {m: tuple(pow(rate, m, PRIME) for rate in rates) for m in range(-HEADS, 1)}
        for batch in batches:
            out, ends = [[] for _ in range(5)], []
            for n, head, k, length, t1, t2, o1, o2, v1, v2, u1, u2 in zip(*(batch.column(c).to_pylist() for c in ("n", "h", "k", "length", "t1", "t2", "o1", "o2", "v1", "v2", "u1", "u2")), strict=True):
                w1, w2 = shift[k - head]
                depth = n - head + k
                for column, x in zip(out, (depth, (t1 + w1 * (u1 - o1)) % PRIME, (t2 + w2 * (u2 - o2)) % PRIME, (t1 + w1 * (v1 - o1)) % PRIME, (t2 + w2 * (v2 - o2)) % PRIME), strict=True):
                    column.append(x)
                ends.append(depth == length)
            yield pa.record_batch([batch.column("conv_id"), *(pa.array(x, pa.int64()) for x in out), batch.column("place"), batch.column("chars"), pa.array(ends, pa.bool_())], names=names)

    names = root.columns
    rebuilt = own.mapInArrow(run, f"{_longs(names[:-1])}, ends boolean")
    return stored(root.unionByName(first).unionByName(rebuilt), "trie_members")


def _grouped(members: DataFrame) -> DataFrame:
    return stored(members.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(f(c).alias(f"{c}_{n}") for c in ("p1", "p2", "ref") for n, f in (("lo", F.min), ("hi", F.max))), F.max("chars").alias("chars")), "trie_groups")


def _holds(groups: DataFrame, members: DataFrame, turns: DataFrame) -> bool:
    """No node mixes parents or last turns; texts are read only where references differ."""
    if not groups.filter((F.col("p1_lo") < F.col("p1_hi")) | (F.col("p2_lo") < F.col("p2_hi"))).isEmpty():
        return False
    mixed = groups.filter(F.col("ref_lo") < F.col("ref_hi")).select(*NODE)
    refs = members.join(mixed, NODE, "left_semi").select(*NODE, "ref").distinct()
    texts = refs.join(turns.select(F.col("place").alias("ref"), "role", "text"), "ref").select(*NODE, "role", "text").distinct()
    return texts.groupBy(*NODE).count().filter("count > 1").isEmpty()


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ``conv_id`` of each node's rows.

    Sorted ids are joined in pieces by as many tasks as there are rows for, then a node's pieces are streamed
    through one digest, which holds one piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, IDS):
                batch = whole.slice(start, IDS)
                keys, out = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True)), []
                ids = batch.column("conv_id").to_pylist()
                for key, run in itertools.groupby(range(len(ids)), key=keys.__getitem__):
                    own = [ids[i] for i in run]
                    out.append((*key, own[0], ",".join(map(str, own))))
                yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=[*NODE, "conv_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], names=names)
                done = []
        if now:
            yield pa.record_batch([pa.array([x]) for x in (*now, sha.hexdigest())], names=names)

    names = [*NODE, "ends_sha256"]
    rows = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = rows.mapInArrow(pieces, f"{_longs([*NODE, 'conv_id'])}, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(digests, f"{_longs(NODE)}, ends_sha256 string")


def _saved_below(nodes: DataFrame) -> DataFrame:
    """What a smallest member's nodes of each depth and deeper save; zero where no other conversation is a member."""
    shared = nodes.filter("n_convs > 1").select(*NODE, "conv_id", "saved", F.floor(F.col("depth") / BLOCK).alias("block"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = shared.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved")).select("conv_id", "block", F.coalesce(F.sum("saved").over(deeper), F.lit(0)).alias("after"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = shared.withColumn("own", F.sum("saved").over(within)).join(blocks, ["conv_id", "block"])
    return sums.select(*NODE, (F.col("own") + F.col("after")).alias("own_saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: smallest member, depth, parent, members, children, leaves, saved code points, digest of the
    conversations that end there.

    Rows without ``conv_id`` belong to no conversation. Null roles and texts are empty. Equal turns of a conversation
    are ordered as ``turns`` says; repeated rows are turns as often as they come. Other columns are not read. An empty
    table has no nodes, not even a root.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    turns = in_order(rows, "conv_id", "trie_turns")
    for attempt in itertools.count():
        rates = multipliers(attempt)
        members = _members(_sums(turns, rates), rates)
        groups = _grouped(members)
        if _holds(groups, members, turns):
            break
    above = groups.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1_lo").alias("f1"), F.col("p2_lo").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = groups.join(above, NODE, "left").select(*NODE, "conv_id", "n_convs", F.col("p1_lo").alias("p1"), F.col("p2_lo").alias("p2"), F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    nodes = stored(nodes, "trie_nodes")
    smallest = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    spread = members.select(*NODE, "conv_id").join(smallest, "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("depth") < F.col("since"), F.col("saved")).otherwise(0)).alias("others_saved"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(spread, NODE).join(_saved_below(nodes), NODE, "left").join(ends_digest(members.filter("ends")), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("others_saved") + F.coalesce("own_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
