"""Token ids as flat files: unsigned integers end to end, 64-bit document offsets beside them.

Documents are range-partitioned and sorted by id. Each partition writes ``part-N.bin`` (its ids, little-endian,
16 bits if the vocabulary allows it, else 32) and ``part-N.idx`` (unsigned 64-bit offsets of its documents in
ids, one more than documents). The place of a partition in the whole follows from prefix sums over the
partitions' totals. Readers map the files into memory and read a document as one slice.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.session import scratch_dir

END_ID = 0
#: Pieces that a task remembers the ids of; beyond it pieces are encoded again.
REMEMBERED = 100_000
#: Words of Latin letters, whose class all Unicode versions agree on, before a run of signs (no apostrophe).
LATIN_END = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]*)([!-&(-/:-@\[-`{-~]*)")
#: White space other than single blanks and line ends, where pieces do not part from each other.
BLANKS = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNEVEN = ("  ", "\n\n", " \n", "\n ", *BLANKS)


class _Pieces(dict):
    """Ids of a piece of text, as bytes, looked up once: the piece follows ``before`` (nothing or a blank).

    A run of Latin letters or of signs is one unit of a byte-level tokenizer, so its model is asked at once.
    """

    def __init__(self, tokenizer, before: str, kind: np.dtype, remembered: int, signs: _Pieces | None = None):
        super().__init__()
        self.tokenizer, self.before, self.kind, self.remembered, self.signs = tokenizer, before, kind, remembered, signs if signs is not None else self
        self.units, self.characters = tokenizer.model.tokenize, byte_characters()
        self.lead = before.encode().decode("latin-1").translate(self.characters)

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            # letters of ASCII stand for themselves
            ids = array(self.kind.char, [t.id for t in self.units(self.lead + piece)]).tobytes()
            if len(self) < self.remembered:
                self[piece] = ids
            return ids
        found, known = LATIN_END.fullmatch(piece), True
        if found is None or not piece:
            ids = self._bytes(self.tokenizer.encode(self.before + piece, add_special_tokens=False).ids)
        elif found[1] and found[2]:
            # a word and signs are kept together only if the word has been met before
            known = found[1] in self
            ids = self[found[1]] + self.signs[found[2]]
        else:
            unit = (self.before + piece).encode().decode("latin-1").translate(self.characters)
            ids = self._bytes([t.id for t in self.units(unit)])
        if known and len(self) < self.remembered:
            self[piece] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes()


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, the others
    from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A byte-level tokenizer parts a text before every blank or line end that stands alone between other
    characters, whatever surrounds it; its pieces there are encoded once and remembered. Texts with other white
    space or with a special token's string, and other kinds of tokenizers, are encoded as a whole.
    """

    def __init__(self, path: str, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        before = spec.get("pre_tokenizer") or {}
        self.parted = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        remembered = REMEMBERED if remembered is None else remembered
        self.bare = _Pieces(self.tokenizer, "", self.kind, remembered)
        self.spaced = _Pieces(self.tokenizer, " ", self.kind, remembered, self.bare)
        self.line_end = self.bare["\n"]

    def _whole(self, text: str) -> bool:
        return not self.parted or any(x in text for x in UNEVEN) or bool(self.special and self.special.search(text))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; a piece that several of them hold is looked up once."""
        out: list[bytes] = [b""] * len(texts)
        parted = []
        for i, text in enumerate(texts):
            if text and self._whole(text):
                out[i] = self.encode(text)
            elif text:
                parted.append(i)
        if not parted:
            return out
        # the line end that marks a text's first piece is left out of its ids
        cut = pc.split_pattern(pa.array(["\n" + texts[i].replace("\n", " \n") for i in parted], pa.large_string()), " ")
        pieces = cut.flatten().dictionary_encode()
        bare, spaced, line_end = self.bare, self.spaced, self.line_end
        known = [
            spaced[p] if p[:1] != "\n" else line_end + bare[p[1:]] if len(p) > 1 else line_end
            for p in pieces.dictionary.to_numpy(zero_copy_only=False)
        ]
        sizes = np.array([len(ids) for ids in known], dtype=np.int64) // self.kind.itemsize
        code = pieces.indices.to_numpy(zero_copy_only=False)
        n = sizes[code]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - n), n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(known), dtype=self.kind)[place]
        bounds = np.concatenate(([0], ends))[cut.offsets.to_numpy()]
        skipped = len(self.line_end) // self.kind.itemsize
        for i, start, end in zip(parted, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[start + skipped : end].tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        spaced, lines = self.spaced.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append((self.bare[first] if first else b"") + b"".join(map(spaced, rest)))
        return self.line_end.join(lines)


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder per Python worker, file and number of remembered pieces; it stays for the worker's later tasks."""
    kept = vars(sys.modules.setdefault("_lorespan_worker", types.ModuleType("_lorespan_worker"))).setdefault("encoders", {})
    if (path, remembered) not in kept:
        kept[path, remembered] = Encoder(path, remembered)
    return kept[path, remembered]


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class TokenFiles:
    """Written token files: their folder, and the tables that name documents and partitions."""

    spark: SparkSession
    folder: str
    id_col: str
    bits: int

    @property
    def documents(self) -> DataFrame:
        """``(part, row, id, n_tokens)`` in file order."""
        return self.spark.read.parquet(f"{self.folder}/documents")

    @property
    def bases(self) -> DataFrame:
        """``(part, base, docs)``: ids and documents of all partitions before it; a row per partition."""
        return self.spark.read.parquet(f"{self.folder}/bases")

    def read(self) -> DataFrame:
        """``(id, start, n_tokens, ids_crc32)`` per document, from the files."""
        folder, bits, id_col = self.folder, self.bits, self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = _folder(folder)
            opened: tuple[int, np.ndarray, pa.NativeFile] | None = None
            for batch in batches:
                starts, counts, sums = [], [], []
                for part, row, base in zip(*(batch.column(c).to_pylist() for c in ("part", "row", "base")), strict=True):
                    if opened is None or opened[0] != part:
                        offsets = _map(store, f"{root}/part-{part:05d}.idx")
                        opened = (part, np.frombuffer(offsets.read_buffer(), dtype="<u8"), _map(store, f"{root}/part-{part:05d}.bin"))
                    first, end = int(opened[1][row]), int(opened[1][row + 1])
                    ids = np.frombuffer(opened[2].read_at((end - first) * bits // 8, first * bits // 8), dtype=f"<u{bits // 8}")
                    starts.append(base + first)
                    counts.append(end - first)
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.record_batch([batch.column(id_col), *(pa.array(x, pa.int64()) for x in (starts, counts, sums))], names=[id_col, "start", "n_tokens", "ids_crc32"])

        kind = self.documents.schema[id_col].dataType
        schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
        # a row per partition of the writing job
        placed = self.documents.join(F.broadcast(self.bases.select("part", "base")), "part")
        return placed.select("part", "row", id_col, "base").mapInArrow(run, schema)


def _map(store: pafs.FileSystem, path: str) -> pa.NativeFile:
    return pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path)


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, folder: str | None = None, remembered: int | None = None) -> TokenFiles:
    """Encodes whole texts and writes them in ascending order of ids; returns the files.

    Each document ends with ``end_id``; null and empty texts are that id alone. Null ids come first, equal ids
    stand beside each other by a hash of their texts; repeated rows are written as often as they come. A
    partition is written under a temporary name and then renamed, so a task that runs again replaces its own
    files with equal ones. ``remembered`` pieces of text are kept by a worker (``REMEMBERED`` if not given).
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "tokens")
    bits = Encoder(tokenizer).kind.itemsize * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _folder(folder)
        store.create_dir(root, recursive=True)
        task, words = TaskContext.get(), encoder(tokenizer, remembered)
        part, end = task.partitionId(), np.array([end_id], dtype=words.kind).tobytes()
        name, offsets, row = f"{root}/part-{part:05d}", [0], 0
        temporary = f"{name}-{task.taskAttemptId()}.tmp"
        ids = None
        for batch in batches:
            counts = []
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(1).slice(start, 256).to_pylist():
                    ids = ids or store.open_output_stream(temporary)
                    data = words.encode(text) + end
                    ids.write(data)
                    counts.append(len(data) // words.kind.itemsize)
                    offsets.append(offsets[-1] + counts[-1])
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.record_batch([pa.array([part] * batch.num_rows, pa.int32()), rows, batch.column(0), pa.array(counts, pa.int64())], names=["part", "row", id_col, "n_tokens"])
        if ids is not None:
            ids.close()
            with store.open_output_stream(f"{temporary}x") as index:
                index.write(np.array(offsets, dtype="<u8").tobytes())
            store.move(temporary, f"{name}.bin")
            store.move(f"{temporary}x", f"{name}.idx")

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])
    parts = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("_tie" if "_tie" not in (id_col, text_col) else "_tie_"))
    tie = parts.columns[2]
    ordered = parts.repartitionByRange(id_col, tie).sortWithinPartitions(id_col, tie)
    ordered.select(id_col, text_col).mapInArrow(run, schema).write.parquet(f"{folder}/documents")
    files = TokenFiles(spark, folder, id_col, bits)
    totals = files.documents.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("tokens", "base"), ("rows", "docs"))))
    bases.write.parquet(f"{folder}/bases")
    return files
