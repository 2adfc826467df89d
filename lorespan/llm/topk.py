"""Exact top-k by inner product with two cover trees.

Queries come in blocks of bounded size, each block against all rows. A task covers the block's queries with one
tree and its rows, chunk by chunk, with another. A pair of nodes is dropped if its covering radii leave no room
for a score above the worst k-th score of the query node; pairs of leaves are scored as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.llm.common import stored

#: Queries of a block, rows of a chunk, points of a leaf, most children of a node, radius of a node by that of its children.
QUERY_BLOCK, CHUNK, LEAF, CHILDREN, RATIO = 8192, 16384, 32, 48, 1.5
#: Pairs of two nodes that are scored at once, though their children might rule some out; rows that are scored at a time.
PAIRS, PIECE = 1 << 14, 512


@dataclass(slots=True)
class Node:
    """Points ``first`` to ``end`` of the tree's order lie within ``radius`` of ``center``."""

    first: int
    end: int
    center: np.ndarray
    norm: float
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """Tree over the points and their order in it; points of a leaf are in the order of ids.

    A node that is larger than a leaf is covered by balls of its radius divided by ``RATIO``: centers are the points
    farthest from all centers before, until every point is covered or there are ``CHILDREN`` of them. Each point goes to
    its nearest center, and each child has the radius that its points need. Points that are all equal are one leaf.
    """
    order: list[np.ndarray] = []

    def grow(rows: np.ndarray, center: np.ndarray, away: np.ndarray, first: int) -> Node:
        radius = float(np.sqrt(away.max()))
        node = Node(first, first + len(rows), center, float(np.sqrt(center @ center)), radius * (1 + 1e-9))
        parts = split(rows, away, radius / RATIO) if len(rows) > leaf and radius > 0 else []
        if len(parts) < 2:
            order.append(rows[np.argsort(ids[rows], kind="stable")])
            return node
        for part, middle, near in parts:
            node.children.append(grow(part, middle, near, first))
            first += len(part)
        return node

    def split(rows: np.ndarray, away: np.ndarray, reach: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        least, owner, centers = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64), []
        farthest = int(np.argmax(away))
        while len(centers) < CHILDREN and least.max() > reach * reach:
            center = points[rows[farthest]]
            distance = ((points[rows] - center) ** 2).sum(axis=1)
            owner[distance < least] = len(centers)
            least = np.minimum(least, distance)
            centers.append(center)
            farthest = int(np.argmax(least))
        return [(rows[owner == n], center, least[owner == n]) for n, center in enumerate(centers) if (owner == n).any()]

    middle = points.mean(axis=0)
    root = grow(np.arange(len(points)), middle, ((points - middle) ** 2).sum(axis=1), 0)
    return root, np.concatenate(order)


class TopK:
    """Best rows so far of each query: score down, then id up."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.root, order = cover_tree(queries, ids)
        self.queries, self.ids, self.k = queries[order], ids[order], k
        self.scored = self.pairs = 0
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, points: np.ndarray, ids: np.ndarray) -> None:
        tree, order = cover_tree(points, ids)
        self.points, self.point_ids = points[order], ids[order]
        self.pairs += len(points) * len(self.ids)
        stack = [(self.root, tree)]
        while stack:
            q, d = stack.pop()
            if self._bound(q, d) < self.scores[q.first : q.end, -1].min():
                continue
            if not q.children and not d.children or (q.end - q.first) * (d.end - d.first) <= PAIRS:
                for first in range(d.first, d.end, PIECE):
                    self._score(q, first, min(first + PIECE, d.end))
                continue
            # the wider node is opened first
            opened = q.children and (not d.children or q.radius >= d.radius)
            pairs = [(x, d) for x in q.children] if opened else [(q, y) for y in d.children]
            stack += sorted(pairs, key=lambda p: self._bound(*p))

    @staticmethod
    def _bound(q: Node, d: Node) -> float:
        bound = float(q.center @ d.center) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius
        return bound + 1e-9 * abs(bound) + 1e-6

    def _score(self, q: Node, first: int, end: int) -> None:
        rows, ids = slice(q.first, q.end), self.point_ids[first:end]
        self.scored += (q.end - q.first) * (end - first)
        scores = self.queries[rows] @ self.points[first:end].T
        worst, last = self.scores[rows, -1:], self.found[rows, -1:]
        better = ((scores > worst) | (scores == worst) & (ids[None, :] < last)) & (ids[None, :] != self.ids[rows, None])
        of, at = np.nonzero(better)
        if not len(of):
            return
        some = np.unique(of)
        owner = np.concatenate([of, np.repeat(some, self.k)])
        score = np.concatenate([scores[of, at], self.scores[rows][some].ravel()])
        name = np.concatenate([ids[at], self.found[rows][some].ravel()])
        order = np.lexsort((name, -score, owner))
        owner, score, name = owner[order], score[order], name[order]
        begin = np.searchsorted(owner, some)
        take = (begin[:, None] + np.arange(self.k)).ravel()
        self.scores[q.first + some] = score[take].reshape(-1, self.k)
        self.found[q.first + some] = name[take].reshape(-1, self.k)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, v)``: components times ``scale``, rounded down; rows with null ids, null vectors or components
    that are null or not finite are left out."""
    v = F.col(vector_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", odd), F.lit(True))).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _search(shared: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        best = TopK(vectors, ids, k)
        held: list[pa.RecordBatch] = []

        def search() -> None:
            if sum(b.num_rows for b in held):
                rows = pa.Table.from_batches(held).combine_chunks()
                points, names = _matrix(rows.column("v").combine_chunks()), rows.column("id").to_numpy()
                for first in range(0, len(names), CHUNK):
                    best.add(points[first : first + CHUNK], names[first : first + CHUNK])
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                search()
        search()
        of, rank = np.nonzero(np.isfinite(best.scores))
        yield pa.record_batch([pa.array(best.ids[of]), pa.array(best.found[of, rank]), pa.array(best.scores[of, rank].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` rows of the highest inner product.

    Ties go to smaller ids. A row of the query's own id is no candidate; repeated rows are candidates each, a
    repeated query id is one query (its least vector). Vectors meet others of their own length only. Scores
    are exact up to 2^53.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, scale)
    queries = stored(vectors.withColumnRenamed("id", id_col).filter(is_query).groupBy(F.col(id_col).alias("id")).agg(F.min("v").alias("v")), "topk_queries")
    found: list[DataFrame] = []
    for size, count in queries.groupBy(F.size("v").alias("size")).count().orderBy("size").collect():
        if not size:
            continue
        blocks = -(-count // QUERY_BLOCK)
        mine = queries.filter(F.size("v") == size).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        for n in range(blocks):
            # about QUERY_BLOCK rows
            block = mine.filter(F.col("block") == n).select("id", "v").toArrow().combine_chunks()
            if block.num_rows:
                shared = spark.sparkContext.broadcast((block.column("id").to_numpy(), _matrix(block.column("v").combine_chunks())))
                best = vectors.filter(F.size("v") == size).mapInArrow(_search(shared, k), SCHEMA)
                found.append(stored(best, "topk_found") if blocks > 1 else best)
    merged = spark.createDataFrame([], SCHEMA)
    for best in found:
        merged = merged.union(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
