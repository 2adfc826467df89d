"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training words stream through the automaton of a block of items; the length of the longest match that ends
at each word is tracked through suffix links. A match of at least ``window`` words, or of a whole shorter
item, is a hit. Blocks bound the size of what a task holds: the items of a block have about ``BLOCK_WORDS``
words, and every block meets all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import ascii_words, fresh

WINDOW = 10
BLOCK_WORDS = 100_000
#: A document with more than this share of its words in test items goes as a whole.
MOST_COVERED = 0.5
# A word before its letters are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of several items; words are numbers, a state knows its items of window length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        numbered = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.window_items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = min([window, *(len(words) for _, words in numbered)])
        for name, words in numbered:
            size, state = min(window, len(words)), 0
            for at, w in enumerate(words, 1):
                state = self.next[state][w]
                if at >= size:
                    found = self._holding(state, size)
                    if size < window:
                        self.short.setdefault(found, []).append((size, name))
                    else:
                        self.window_items.setdefault(found, set()).add(name)
        # the suffix of window length of each state, and the nearest state on its suffix path that ends a short item
        self.holder = [self._holding(s, window) if n >= window else -1 for s, n in enumerate(self.length)]
        self.ending = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.ending[s] = s if s in self.short else self.ending[self.link[s]]

    @classmethod
    def of_parts(cls, parts: dict) -> Automaton:
        """The automaton whose plain parts were broadcast."""
        automaton = cls.__new__(cls)
        vars(automaton).update(parts)
        return automaton

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _holding(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint sorted spans of hit words ``[start, end)`` and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set[str] = set()
        numbers = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, numbers >= 0, False]))
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - first >= self.least:
                self._stream(numbers[first:end].tolist(), first, spans, items)
        return [(a, b) for a, b in spans], items

    def _stream(self, numbers: list[int], at: int, spans: list[list[int]], items: set[str]) -> None:
        moves, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at, w in enumerate(numbers, at + 1):  # noqa: B020
            step = moves[state].get(w)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = moves[state].get(w)
            if step is None:
                continue
            state, matched = step, matched + 1
            size = 0
            if matched >= window:
                size = window
                items |= self.window_items[self.holder[state]]
            end = self.ending[state]
            while end > 0:
                for n, name in self.short[end]:
                    if n <= matched:
                        items.add(name)
                        size = max(size, n)
                end = self.ending[link[end]] if link[end] > 0 else -1
            if size:
                start = at - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, at])


def item_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of bounded size, built one at a time; items with null id or without words take no part."""
    named = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    words = named.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-words // (6 * block_words)))
    cut = named.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for n in range(blocks):
        yield Automaton([(r.item, ascii_words(r.text)) for r in cut.filter(F.col("block") == n).orderBy("item", "text").collect()], window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<first:int,end:int>>"
ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _found(shared: Broadcast):
    @F.arrow_udf(f"n_words long, spans {SPANS}, items array<string>")
    def found(texts: pa.Array) -> pa.Array:
        automaton, rows = Automaton.of_parts(shared.value), []
        for text in texts:
            words = ascii_words(text.as_py())
            spans, names = automaton.hits(words)
            rows.append({"n_words": len(words), "spans": [{"first": a, "end": b} for a, b in spans], "items": sorted(names)})
        return pa.array(rows, ARROW)

    return found


def word_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", name: str = "hits", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with a struct: ``n_words``, ``spans`` of hit words, ``items`` whose windows occur.

    Null and empty texts have no words and no hits; rows stay as they are. Several blocks of items are several
    columns that are merged in the row, so no row moves.
    """
    spark, parts, frame = docs.sparkSession, [], docs
    for automaton in item_blocks(items, window, block_words):
        found = _found(spark.sparkContext.broadcast(vars(automaton)))
        parts.append(fresh(frame, f"{name}_part"))
        frame = frame.withColumn(parts[-1], found(F.col(text_col)))
    if len(parts) == 1:
        return frame.withColumnRenamed(parts[0], name) if name not in docs.columns else frame.withColumn(name, F.col(parts[0])).drop(parts[0])

    @F.udf(SPANS)
    def joined(spans):
        return _merged([(s.first, s.end) for s in spans])

    spans = joined(F.flatten(F.array(*(F.col(f"{p}.spans") for p in parts))))
    names = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"{p}.items") for p in parts)))))
    whole = F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), spans.alias("spans"), names.alias("items"))
    return frame.withColumn(name, whole).drop(*parts)


def hit_count(hits: str) -> Column:
    """Words inside spans."""
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    The sum is of the item ids sorted as strings and joined by commas; no items give that of the empty string.
    """
    found = word_hits(docs.select("doc_id", "text"), items)
    hit = hit_count("hits")
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    ends = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for first, end in spans:
        out.append(text[at : ends[first][0]])
        at = ends[end - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", most_covered: float = MOST_COVERED) -> DataFrame:
    """``docs`` without the passages of test items: hit spans are cut out of the text, and a document of which
    more than ``most_covered`` of the words are hit goes. Other rows, null and empty texts too, stay unchanged.

    A column ``n_chars`` follows the new text.
    """
    hits = fresh(docs, "hits")
    found = word_hits(docs, items, text_col, hits)
    found = found.filter(hit_count(hits) <= F.col(f"{hits}.n_words") * most_covered)

    @F.udf("string")
    def cut(text, spans):
        return cut_text(text, [(s.first, s.end) for s in spans]) if spans else text

    clean = F.size(f"{hits}.spans") == 0
    # rows without spans pass null to the function, so their texts stay where they are
    shorter = cut(F.when(~clean, F.col(text_col)), F.when(~clean, F.col(f"{hits}.spans")))
    name = fresh(docs, "shorter")
    found = found.withColumn(name, shorter)
    columns = {text_col: F.when(clean, F.col(text_col)).otherwise(F.col(name))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(clean, F.col("n_chars")).otherwise(F.length(name).cast(docs.schema["n_chars"].dataType))
    return found.withColumns(columns).select(*docs.columns)
