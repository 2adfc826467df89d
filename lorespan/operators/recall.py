"""Recall of past sessions by vector similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.functions import text
from lorespan.session import stored as written

# Similarity a match needs, vector size of the default encoder.
THRESHOLD = 0.40
EMBED_DIM = 384
#: Query vectors and stored vectors that are multiplied at a time.
QUERY_BLOCK, STORED_BLOCK = 256, 512
#: Decimals of a similarity.
DIGITS = 4


def hashed_features(token: Column, dim: int) -> Column:
    """Place and sign of a token, from its MD5: the first eight hexadecimal digits modulo ``dim``, and whether the ninth is
    even. Any engine with MD5 gets the same."""
    digest = F.md5(token.cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return F.struct(place.cast("int").alias("place"), sign.alias("sign"))


def hashed_embedding(df: DataFrame, text_col: str, out: str = "embedding", dim: int = EMBED_DIM) -> DataFrame:
    """Default encoder: signed hashed word counts scaled to length 1; a text without words is the zero vector. A caller's
    own model goes through ``encode``."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vector(places: pa.Array, signs: pa.Array) -> pa.Array:
        rows = []
        for place, sign in zip(places, signs, strict=True):
            counts = np.bincount(place.as_py() or [], sign.as_py() or None, dim).astype(np.float64)
            length = np.sqrt(counts @ counts)
            rows.append((counts / length if length else counts).astype(np.float32))
        return pa.array(rows, pa.list_(pa.float32()))

    found = df.withColumn("_features", F.transform(text.index_tokens(F.col(text_col)), lambda t: hashed_features(t, dim)))
    return found.select(*df.columns, vector(F.col("_features.place"), F.col("_features.sign")).alias(out))


def encode(df: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """Embeds a text column with the caller's model: ``load`` runs once per task, the model per batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            vectors = np.asarray(model(batch[text_col].fillna("").tolist()), dtype=np.float32)
            yield batch.assign(**{out: list(vectors)})

    return df.mapInPandas(run, schema)


def _packed(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """Rows (id, vec) as blocks of at most ``size``: ``(ids, flat, dim)`` for each vector length, packed where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        open_blocks: dict[int, tuple[list, list]] = {}

        def closed(dim: int) -> pa.RecordBatch:
            ids, vectors = open_blocks.pop(dim)
            flat = np.concatenate(vectors) if dim else np.zeros(0)
            return pa.record_batch([pa.array([ids], pa.list_(kind)), pa.array([flat], pa.list_(pa.float64())), pa.array([dim], pa.int32())], names=["ids", "flat", "dim"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for row_id, vec in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.asarray(vec.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                ids, vectors = open_blocks.setdefault(len(values), ([], []))
                ids.append(row_id)
                vectors.append(values)
                if len(ids) == size:
                    yield closed(len(values))
        for dim in list(open_blocks):
            yield closed(dim)

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.filter(F.col("vec").isNotNull()).select(id_col, "vec").mapInArrow(run, f"ids array<{kind}>, flat array<double>, dim int")


def _best(similarity: np.ndarray, order: np.ndarray, k: int | None, threshold: float | None) -> np.ndarray:
    """Columns of one query's block to keep: over the threshold, and the k best, the earlier in ``order`` at ties."""
    kept = order if threshold is None else order[similarity[order] >= threshold]
    return kept if k is None or len(kept) <= k else kept[np.argsort(-similarity[kept], kind="stable")[:k]]


def similarities(queries: DataFrame, stored: DataFrame, threshold: float | None = None, k: int | None = None) -> DataFrame:
    """(query_id, id, similarity): cosine of every query vector with every stored one, 4 decimals, 0 for a zero vector.

    Queries (query_id, vec) and stored rows (id, vec) are packed into blocks; each pair of blocks is one matrix product in
    a task. ``threshold`` and ``k`` are applied to a block's product before anything is sent on, and ``k`` again over all
    blocks; of equal similarities the smaller id comes first. Vectors of other lengths than the query's, and null vectors,
    take no part. Query blocks are broadcast when small by Spark's size check; else both sides are dealt by query block.
    """
    id_kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((stored, "id"), (queries, "query_id")))
    asked = _packed(queries, "query_id", QUERY_BLOCK).select(F.col("ids").alias("asked"), F.col("flat").alias("q"), "dim", F.monotonically_increasing_id().alias("block"))
    asked = written(asked, "query_blocks")
    blocks = asked.agg(F.collect_set(F.struct("dim", "block"))).scalar()
    rows = _packed(stored, "id", STORED_BLOCK).select("ids", "flat", "dim", F.explode(blocks).alias("b"))
    rows = rows.filter(F.col("b.dim") == F.col("dim")).select("ids", "flat", "dim", F.col("b.block").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flat, asked_ids, q, dim in zip(*(batch.column(c) for c in ("ids", "flat", "asked", "q", "dim")), strict=True):
                a = q.values.to_numpy().reshape(-1, dim.as_py())
                b = flat.values.to_numpy().reshape(-1, dim.as_py())
                names = ids.as_py()
                scale = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
                raw = np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale != 0)
                rounded = np.copysign(np.floor(np.abs(raw) * 10**DIGITS + 0.5) / 10**DIGITS, raw) + 0.0
                order = np.array(sorted(range(len(names)), key=names.__getitem__))
                found = [(query, j, rounded[i, j]) for i, query in enumerate(asked_ids.as_py()) for j in _best(rounded[i], order, k, threshold)]
                if found:
                    query, j, similarity = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(query, asked_ids.type.value_type), pa.array([names[x] for x in j], ids.type.value_type), pa.array(similarity, pa.float64())], names=["query_id", "id", "similarity"])

    found = rows.join(asked, ["dim", "block"]).mapInArrow(run, f"query_id {query_kind}, id {id_kind}, similarity double")
    if k is None:
        return found
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def ranking(queries: DataFrame, stored: DataFrame, threshold: float = THRESHOLD, k: int | None = None) -> DataFrame:
    """Stored sessions per query, all or the ``k`` nearest, nearest first, with a mark for those over the threshold."""
    return (
        similarities(queries, stored, k=k)
        .withColumn("accepted", F.col("similarity") >= threshold)
        .orderBy("query_id", F.desc("similarity"), "id")
    )


def best_match(queries: DataFrame, stored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Nearest session per query if it is near enough; the smaller id wins a tie."""
    return similarities(queries, stored, threshold, 1)


def session_list(memory: DataFrame) -> DataFrame:
    return memory.select(
        "id", "session_id", "task_text", F.size("context_files").alias("n_files"), F.size("context_symbols").alias("n_symbols"),
        "tokens_used", "outcome", "confidence", "created_at",
    ).orderBy(F.desc("created_at"), F.desc("id"))
