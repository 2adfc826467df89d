"""Packing of documents into training sequences beside lexically near ones.

The words of retrieval are token ids, so the vocabulary bounds their statistics: document frequencies of the whole
corpus are one number per id, and every task gets them. Each document names its two most telling ids, by the documents its
task has read before it; documents are range-partitioned and sorted by these, so that near ones lie together, and a group
of any size is spread. Each task reads its documents in shards of bounded tokens and builds a BM25 inverted index over each shard. A seed document opens a
sequence; the index returns the unused documents of the shard nearest to it, and the sequence takes them in this order as
far as they fit whole; then the nearest one left is cut to fill the rest, and what remains of it opens the next sequence.
A sequence goes on into the task's next shard, so every sequence is full but the last one of a task, which is cut into
powers of two: no id is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import stored
from lorespan.llm.token_files import Encoder, encoder

WINDOW, END_ID = 2048, 1
#: A shard closes at so many token ids, or so many documents.
SHARD_IDS, SHARD_DOCS = 1 << 20, 1024
K1, B = 1.2, 0.75
#: Ids of a seed that the index is asked for: its rarest ones. What it returns orders documents and leaves none out.
ASKED = 32
#: Pieces of text that a task remembers the ids of; beyond it pieces are encoded again.
REMEMBERED = 1_000_000
#: Bytes of texts that are encoded together, and the text that goes beyond them.
TOGETHER = 4 << 20
PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """``(doc_id, ids, n, told, told_next, check, met)`` of every row: token ids of the whole text and the end id, as
    little-endian integers, their number, the two ids that tell most of it (the smaller at ties) and a check sum.

    The last row of a task has no ids: ``met`` holds in how many of its documents each token id occurs.
    """
    kind = Encoder(tokenizer).kind
    size = 1 << 16 if kind.itemsize == 2 else 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, read, id_kind = encoder(tokenizer, REMEMBERED), np.zeros(size, dtype=np.uint32), 0, None
        end = np.array([end_id], dtype=words.kind).tobytes()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = [0, *(np.flatnonzero(np.diff(held // TOGETHER)) + 1).tolist()] if len(held) else []
            for start, stop in zip(starts, [*starts[1:], len(held)], strict=False):
                part = batch.slice(start, stop - start)
                found = []
                for data in words.encode_all(part.column(1).to_pylist()):
                    data += end
                    own, times = np.unique(np.frombuffer(data, dtype=kind), return_counts=True)
                    counts[own] += 1
                    read += 1
                    seen = counts[own]
                    weight = np.log1p((read - seen + 0.5) / (seen + 0.5)) * (times * (K1 + 1) / (times + K1))
                    first = int(np.argmax(weight))
                    weight[first] = -1 if len(own) > 1 else 0
                    found.append((data, len(data) // kind.itemsize, int(own[first]), int(own[int(np.argmax(weight))]), zlib.crc32(data), None))
                columns = zip(zip(*found, strict=True), kinds, strict=True)
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in columns)], names=names)
        if id_kind is not None:
            yield pa.record_batch([pa.nulls(1, id_kind), *(pa.nulls(1, k) for k in kinds[:-1]), pa.array([counts.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "ids", "n", "told", "told_next", "check", "met"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary, n long, told int, told_next int, check long, met binary")


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """Documents per token id in the whole corpus, summed up from those of the tasks; every task sends a row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0):
                counts = np.frombuffer(data.as_buffer(), dtype=np.uint32).astype(np.int64)
                total = counts if total is None else total + counts
        if total is not None:
            found = np.flatnonzero(total)
            yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["token", "n"])

    # a row per id of the vocabulary
    rows = tokens.filter("met IS NOT NULL").select("met").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.token for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r.token] = r.n
    return counts


def _idf(counts: np.ndarray, docs: int) -> np.ndarray:
    return np.log1p((docs - counts + 0.5) / (counts + 0.5)).astype(np.float32)


class Shard:
    """BM25 inverted index over documents held in memory; used documents leave it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.words = [np.unique(d, return_counts=True) for d in docs]
        sizes = [len(w) for w, _ in self.words]
        owner = np.repeat(np.arange(len(docs)), sizes)
        word = np.concatenate([w for w, _ in self.words]).astype(np.int64)
        n = np.concatenate([c for _, c in self.words])
        length = np.repeat([len(d) for d in docs], sizes)
        weight = idf[word] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))
        order = np.argsort(word, kind="stable")
        self.owner, self.weight, self.idf = owner[order], weight[order].astype(np.float32), idf
        self.vocabulary, self.first = np.unique(word[order], return_index=True)
        self.last = np.append(self.first[1:], len(word))
        self.unused = np.ones(len(docs), dtype=bool)

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Unused documents by their score for these distinct ids, best first; the earlier one at ties."""
        asked = words[np.argsort(-self.idf[words], kind="stable")[:ASKED]]
        at = np.minimum(np.searchsorted(self.vocabulary, asked), len(self.vocabulary) - 1)
        spans = [slice(self.first[i], self.last[i]) for i in at[self.vocabulary[at] == asked]]
        scores = np.zeros(len(self.unused), dtype=np.float64)
        if spans:
            scores = np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.unused))
        left = np.nonzero(self.unused)[0]
        return left[np.argsort(-scores[left], kind="stable")]


class Packer:
    """Sequences of one task, filled from shard after shard."""

    def __init__(self, first_sequence: int, window: int, idf: np.ndarray, mean: float):
        self.sequence, self.window, self.idf, self.mean = first_sequence, window, idf, mean
        self.open: list[tuple] = []  # (id, all ids, start, length) of the pieces of the open sequence
        self.room, self.seed = window, None

    def _close(self) -> list[tuple]:
        out, offset = [], 0
        for doc_id, ids, start, length in self.open:
            out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), self.sequence, offset))
            offset += length
        self.sequence, self.open, self.room, self.seed = self.sequence + 1, [], self.window, None
        return out

    def _put(self, doc_id: object, ids: np.ndarray, words: np.ndarray) -> Iterator[tuple]:
        """The whole document, over as many sequences as it needs; its last piece is the seed of a sequence it opens."""
        start = 0
        while start < len(ids):
            length = min(self.room, len(ids) - start)
            if self.seed is None:
                self.seed = words
            self.open.append((doc_id, ids, start, length))
            start, self.room = start + length, self.room - length
            if not self.room:
                yield from self._close()

    def shard(self, rows: list[tuple]) -> Iterator[tuple]:
        """Pieces of all closed sequences, after all documents of a shard are used."""
        ids = [r[1] for r in rows]
        index, lengths = Shard(ids, self.idf, self.mean), np.array([len(d) for d in ids])
        while index.unused.any():
            if self.seed is None:
                chosen = int(np.argmax(index.unused))  # the first one opens a sequence
                index.unused[chosen] = False
                yield from self._put(rows[chosen][0], ids[chosen], index.words[chosen][0].astype(np.int64))
                continue
            ranked, sequence = index.nearest(self.seed), self.sequence
            for chosen in ranked.tolist():
                if lengths[chosen] <= self.room:
                    index.unused[chosen] = False
                    yield from self._put(rows[chosen][0], ids[chosen], index.words[chosen][0].astype(np.int64))
                    if self.sequence != sequence:
                        break
            else:
                left = ranked[index.unused[ranked]]
                if len(left):
                    chosen = int(left[0])
                    index.unused[chosen] = False
                    yield from self._put(rows[chosen][0], ids[chosen], index.words[chosen][0].astype(np.int64))

    def end(self) -> Iterator[tuple]:
        """The open sequence, cut into powers of two from the largest on."""
        pieces, self.open = self.open, []
        total = sum(p[3] for p in pieces)
        while total:
            room = 1 << total.bit_length() - 1
            total -= room
            while room:
                doc_id, ids, start, length = pieces.pop(0)
                taken = min(room, length)
                self.open.append((doc_id, ids, start, taken))
                room -= taken
                if taken < length:
                    pieces.insert(0, (doc_id, ids, start + taken, length - taken))
            yield from self._close()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row per piece of a document: its place in the document, check sum, sequence and offset there; the id is
    named ``doc_id``.

    A null or empty text is its end id alone. Null ids and repeated rows are packed like any other row. A text longer than
    the window is cut over sequences. Documents of equal ids and texts are interchangeable; the order of all others, and so
    the result, depends on the rows and on the number of partitions. Other columns are not read. An empty table gives no row.
    Sequence ids are unique, not consecutive.
    """
    kind = Encoder(tokenizer).kind
    tokens = stored(encoded(docs, tokenizer, id_col, text_col, end_id), "packing_ids")
    whole = tokens.filter("n IS NOT NULL")
    n_docs, total = whole.agg(F.count(F.lit(1)), F.sum("n")).first()
    idf, mean = _idf(document_frequencies(tokens), n_docs), (total or 0) / max(n_docs, 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch_of(pieces: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        first, *rest = zip(*pieces, strict=True)
        return pa.record_batch([pa.array(first, ids), *(pa.array(c, pa.int64()) for c in rest)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, window, idf, mean)
        rows, held, id_kind = [], 0, None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append((doc_id, np.frombuffer(data.as_py(), dtype=kind)))
                held += len(rows[-1][1])
                if held >= SHARD_IDS or len(rows) >= SHARD_DOCS:
                    if pieces := list(packer.shard(rows)):
                        yield batch_of(pieces, id_kind)
                    rows, held = [], 0
        if pieces := [*(packer.shard(rows) if rows else ()), *packer.end()]:
            yield batch_of(pieces, id_kind)

    order = ["told", "told_next", "check", F.xxhash64("doc_id")]
    placed = whole.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    return placed.mapInArrow(run, PIECES.format(docs.schema[id_col].dataType.simpleString()))

