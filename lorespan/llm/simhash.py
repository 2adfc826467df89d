"""SimHash near-duplicate classes, compared as vertical bit planes.

A document's fingerprint is the bitwise majority over the XXH64 hashes of its word shingles. Equal
fingerprints are one class before anything is compared, so exact copies cost one row. Classes meet in
buckets of equal key bits; bit planes are stored vertically (one bit per member), the distances of many members
are updated at once by carry-save counters, and a block is abandoned once all its counters exceed the radius. Small
buckets share the words of one set of planes. A bucket emits a spanning forest of its links, never its pairs. Groups
are the connected components of those links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.llm.common import fresh, space_words, stored

SEED = 42
#: Members of a bucket that are compared with each other in one task; larger buckets go by masked keys.
BUCKET_LIMIT = 8192
#: Members of small buckets that go through the counters at a time.
MEMBERS = 4096
#: Hashes turned into bits at a time.
CHUNK = 1 << 15
#: Texts whose hashes a worker holds at a time.
SLICE = 128


def _hashes(words: list[bytes], shingle: int) -> list[int]:
    if not words:
        return []
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(text, SEED)]
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    return [digest(text[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:], strict=False)]


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive runs of hashes; a run of none has fingerprint zero."""
    counts = np.zeros((len(sizes), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + CHUNK]
        firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
    majority = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(majority).view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` per row; fp is the 64-bit fingerprint as a signed long.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles count as often as they occur; a text of
    fewer words is one shingle; null or no words give 0. Rows with null or repeated ids stay. Other columns
    of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                ids = batch.column(0).slice(start, SLICE)
                found = [_hashes(space_words(t), shingle) for t in batch.column(1).slice(start, SLICE).to_pylist()]
                sizes = np.array([len(h) for h in found], dtype=np.int64)
                fp = _majority(np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint64, count=sizes.sum()), sizes)
                yield pa.record_batch([ids, pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pigeonhole_keys(fp: Column, radius: int) -> Column:
    """Array of keys: fingerprints within ``radius`` bits share at least one.

    The bits form ``radius + 2`` bands; differing bits touch at most ``radius`` of them, so some two bands agree.
    """
    bands = radius + 2
    edges = [64 * k // bands for k in range(bands + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(edges)]
    pairs = itertools.combinations(range(bands), 2)
    return F.array(*(F.shiftleft(F.lit(n).cast("long"), 56).bitwiseXOR(F.shiftleft(part[a], 27)).bitwiseXOR(part[b]) for n, (a, b) in enumerate(pairs)))


def _forest(n: int, pairs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            yield a, b


class _Counters:
    """Vertical counters: adds one bit plane at a time, holding carries back until two of a weight meet."""

    def __init__(self, shape: tuple[int, int], radius: int):
        self.radius, self.width = radius, (radius + 1).bit_length()
        self.sums = [np.zeros(shape, dtype=np.uint64) for _ in range(self.width)]
        self.waiting: list[np.ndarray | None] = [None] * self.width
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, x: np.ndarray, k: int = 0) -> None:
        while k < self.width:
            held, self.waiting[k] = self.waiting[k], None
            if held is None:
                self.waiting[k] = x
                return
            half = self.sums[k] ^ held
            carry = (self.sums[k] & held) | (half & x)
            self.sums[k] = half ^ x
            x, k = carry, k + 1
        self.over |= x

    def beyond(self) -> np.ndarray:
        """Bits of members whose count is over the radius by now; what waits is counted at the end only."""
        more, equal = self.over.copy(), np.full_like(self.over, ~np.uint64(0))
        for k in reversed(range(self.width)):
            if self.radius >> k & 1:
                equal &= self.sums[k]
            else:
                more |= equal & self.sums[k]
                equal &= ~self.sums[k]
        return more

    def within(self) -> np.ndarray:
        for k in range(self.width):
            held, self.waiting[k] = self.waiting[k], None
            while held is not None and k < self.width:
                held, self.sums[k], k = self.sums[k] & held, self.sums[k] ^ held, k + 1
                if k == self.width:
                    self.over |= held
        return ~self.beyond()


class Planes:
    """Bit planes of one bucket: plane p has bit p of member 64 * w + i at bit i of word w."""

    BLOCK = 16

    def __init__(self, words: np.ndarray, radius: int):
        self.n, self.radius = len(words), radius
        self.bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little")
        width = -(-self.n // 64)
        flat = np.zeros((self.bits.shape[1], width * 8), dtype=np.uint8)
        packed = np.packbits(self.bits.T, axis=1, bitorder="little")
        flat[:, : packed.shape[1]] = packed
        self.planes = flat.view(np.uint64)
        self.real = np.zeros(width * 8, dtype=np.uint8)
        ones = np.packbits(np.ones(self.n, dtype=np.uint8), bitorder="little")
        self.real[: len(ones)] = ones
        self.real = self.real.view(np.uint64)

    def near(self, members: np.ndarray) -> np.ndarray:
        """Rows of bits: which members of the bucket lie within the radius of each of ``members``."""
        wanted = (np.uint64(0) - self.bits[members].astype(np.uint64)).T[:, :, None]
        out = np.zeros((len(members), self.planes.shape[1]), dtype=np.uint64)
        for at in range(0, out.shape[1], self.BLOCK):
            block, real = self.planes[:, at : at + self.BLOCK], self.real[at : at + self.BLOCK]
            counters = _Counters((len(members), block.shape[1]), self.radius)
            for p in range(len(block)):
                counters.add(block[p][None, :] ^ wanted[p])
                if p % 16 == 15 and not ((~counters.beyond()) & real).any():
                    break
            else:
                out[:, at : at + self.BLOCK] = counters.within() & real
        return out

    def forest(self) -> Iterator[tuple[int, int]]:
        """Links that connect the members as all links within the radius do."""
        unseen = self.real.copy()

        def take(row: np.ndarray) -> np.ndarray:
            found = row & unseen
            if not found.any():
                return np.zeros(0, dtype=np.int64)
            np.bitwise_and(unseen, ~found, out=unseen)
            return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))

        for seed in range(self.n):
            if not int(unseen[seed >> 6]) >> (seed & 63) & 1:
                continue
            unseen[seed >> 6] &= ~np.uint64(1 << (seed & 63))
            front = [seed]
            while front:
                part, front = np.array(front[:128]), front[128:]
                for a, row in zip(part, self.near(part), strict=True):
                    new = take(row)
                    front += new.tolist()
                    yield from ((int(a), int(b)) for b in new)


def _slots(sizes: np.ndarray) -> np.ndarray:
    """Places for buckets of at most 64 members, one after the other, none across a multiple of 64."""
    firsts, at = [], 0
    for size in sizes.tolist():
        if at % 64 + size > 64:
            at += 64 - at % 64
        firsts.append(at)
        at += size
    return np.array(firsts, dtype=np.int64)


def small_bucket_links(words: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links of many buckets of at most 64 members, which lie one after the other in ``words``.

    Buckets share the words of the planes: each member meets the one word in which its bucket lies, and all members of a
    block go through the counters at once. A block whose members are all beyond the radius of their mates is abandoned.
    """
    firsts = np.r_[0, np.cumsum(sizes)[:-1]]
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    shift = np.repeat(_slots(sizes) - firsts, sizes)
    slots = np.arange(len(words)) + shift
    flat = np.zeros((bits.shape[1], int(slots[-1]) // 64 * 64 + 64), dtype=np.uint8)
    flat[:, slots] = bits.T
    planes = np.packbits(flat, axis=1, bitorder="little").view(np.uint64)
    low = np.repeat((_slots(sizes) % 64).astype(np.uint64), sizes)
    size = np.repeat(sizes.astype(np.uint64), sizes)
    # the bits after the own one: each pair is met once
    after = low + size - np.uint64(1) - (slots % 64).astype(np.uint64)
    mates = np.where(after > 0, (~np.uint64(0) >> (np.uint64(64) - np.maximum(after, np.uint64(1)))), np.uint64(0))
    mates = np.where(after > 0, mates << ((slots % 64).astype(np.uint64) + np.uint64(1)) % np.uint64(64), np.uint64(0))
    found: list[tuple[int, int]] = []
    for start in range(0, len(words), MEMBERS):
        part = slice(start, start + MEMBERS)
        word, wanted, real = slots[part] // 64, np.uint64(0) - bits[part].astype(np.uint64), mates[part]
        counters = _Counters((len(word),), radius)
        for p in range(len(planes)):
            counters.add(planes[p][word] ^ wanted[:, p])
            if p % 16 == 15 and not (~counters.beyond() & real).any():
                break
        else:
            near = counters.within() & real
            for a in np.flatnonzero(near).tolist():
                row, base = int(near[a]), start + a - int(slots[start + a] % 64)
                while row:
                    lowest = row & -row
                    found.append((start + a, base + lowest.bit_length() - 1))
                    row ^= lowest
    yield from _forest(len(words), found)


def links(classes: DataFrame, node: str, keys: Column, compare: list[str], radius: int) -> DataFrame:
    """``(a, b)``: links that connect all classes which share a key and differ in at most ``radius`` bits.

    ``classes`` has one row per distinct fingerprint. Buckets over ``BUCKET_LIMIT`` members are cut by further
    bits of the compared fingerprints until they fit (``_split_hot``), so none is skipped or cut off.
    """
    keyed = classes.select(F.col(node).alias("node"), *compare, F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = stored(keyed.join(sizes, "key"), "simhash_buckets")
    most = shared.agg(F.max("members")).first()[0] or 0
    linked = _linked(shared.filter(F.col("members") <= BUCKET_LIMIT).select("key", "node", *compare), shared.schema["node"].dataType, compare, radius)
    if most > BUCKET_LIMIT:
        linked = linked.union(_split_hot(shared.filter(F.col("members") > BUCKET_LIMIT).select("key", "node", *compare), compare, radius))
    return linked.distinct()


def _split_hot(rows: DataFrame, compare: list[str], radius: int) -> DataFrame:
    """Links in oversized buckets, exact: blocks of members meet block by block, each pair of blocks one bucket.

    A block is a hash slice of the bucket; a pair of blocks holds at most about ``BUCKET_LIMIT`` members.
    """
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (BUCKET_LIMIT // 4)).alias("blocks"))
    cut = rows.join(counts, "key").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    pairs = pairs.select(F.xxhash64("key", low, high).alias("key"), "node", *compare)
    return _linked(pairs, rows.schema["node"].dataType, compare, radius)


def _bucket_links(words: np.ndarray, firsts: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links of the buckets that begin at ``firsts``, the last of which is the end; members of a bucket are together."""
    small = []
    for a, b in itertools.pairwise(firsts):
        if b - a > 64:
            yield from ((a + x, a + y) for x, y in Planes(words[a:b], radius).forest())
        elif b - a > 1:
            small.append((a, b))
    if small:
        rows = np.concatenate([np.arange(a, b) for a, b in small])
        yield from ((int(rows[x]), int(rows[y])) for x, y in small_bucket_links(words[rows], np.array([b - a for a, b in small]), radius))


def _linked(rows: DataFrame, node_type: T.DataType, compare: list[str], radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(keys: np.ndarray, nodes: pa.Array, words: np.ndarray) -> pa.RecordBatch:
            firsts = [*np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist(), len(keys)] if len(keys) else [0]
            edges = list(_bucket_links(words, firsts, radius))
            left, right = (pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1))
            return pa.record_batch([nodes.take(left), nodes.take(right)], names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            keys = held.column("key").to_numpy()
            # the last key may go on in the next batch
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield ended(*_columns(held.slice(0, done), compare))
                held = held.slice(done)
        if held is not None:
            yield ended(*_columns(held, compare))

    schema = T.StructType([T.StructField("a", node_type), T.StructField("b", node_type)])
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _columns(held: pa.Table, compare: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    words = np.stack([held.column(c).to_numpy() for c in compare], axis=1).view(np.uint64)
    return held.column("key").to_numpy(), held.column("node").combine_chunks(), np.ascontiguousarray(words)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)``; root is the smallest node it reaches.

    Every round points a node to its smallest neighbour, follows that pointer twice and contracts the edges;
    the nodes left at least halve. Each round is a written table, so a lost executor costs one round at most.
    """
    edges = stored(edges.filter("a <> b").select("a", "b"), "edges")
    merged: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        parent = stored(parent.select(F.col("a").alias("node"), "up"), "parents")
        higher = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = stored(parent.join(higher, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "pointers")
        if merged is None:
            merged = parent.select("node", F.col("up").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), "up")
            merged = stored(merged.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        ends = [parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("a", "b")]
        pairs = edges.join(ends[0], "a").join(ends[1], "b").filter("a_up <> b_up")
        edges = stored(pairs.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct(), "edges")
    return merged if merged is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row of ``docs``.

    Fingerprints within ``radius`` bits are linked, exactly; component_id is the smallest id reachable, the own
    included (null ids count for nothing; a component of null ids only has null). The empty text has
    fingerprint zero and links like any other. Repeated rows come back as often as they were given.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash_classes")
    found = components(links(classes, "fp", pigeonhole_keys(F.col("fp"), radius), ["fp"], radius))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Rows of ``docs`` in all their columns, one of each component of ``near_duplicates``: the smallest id, nulls last.

    Ties of an id go by a hash of the row's text; of rows equal in both any one stays. Texts without words are one
    group. An empty table stays empty.
    """
    row = [fresh(docs, name) for name in ("row_a", "row_b")]
    keyed = docs.withColumns({c: F.xxhash64(F.lit(n), id_col, text_col) for n, c in enumerate(row)})
    name = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), *(F.col(c).alias(f"r{n}") for n, c in enumerate(row)))
    found = near_duplicates(keyed.select(name.alias("name"), F.col(text_col).alias("text")), "name", "text", shingle, radius)
    first = found.filter(F.col("name") == F.col("component_id")).select(*(F.col(f"name.r{n}").alias(c) for n, c in enumerate(row))).distinct()
    kept = keyed.join(stored(first, "simhash_kept"), row).dropDuplicates(row)
    return kept.select(*(kept[f"`{c}`"] for c in docs.columns))
