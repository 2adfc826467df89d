"""Licence texts by a positional index of rare words.

Templates are known licence notices. Document frequencies over the whole corpus rate their words; the rarest
words of each template that a file has are looked up, the template's postings are intersected with the file's
positions by relative position, and a place counts only if the template's mandatory phrase stands there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import ascii_words, fresh

# Phrases that every scan counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices of public licences: label, words of the notice, mandatory phrase within it.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc0-1.0", "released under cc0 1 0 universal", "cc0 1 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Rarest words of a template that are looked up in a file.
ANCHORS = 4
#: A mandatory phrase may stand this many words off the place that the anchors agree on.
SLACK = 3
#: Share of a template's rarity that has to stand at a place for its label.
LEAST_SHARE = 0.4


class Index:
    """Templates with words as bytes, their places, and a weight per word."""

    def __init__(self, frequency: dict[bytes, int], documents: int, templates: tuple[tuple[str, str, str], ...] = TEMPLATES):
        self.weight = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in vocabulary(templates)}
        self.base = [(label, phrase.encode().split()) for phrase, label in BASE.items()]
        self.templates = []
        for label, text, phrase in templates:
            words, must = text.encode().split(), phrase.encode().split()
            at = next(k for k in range(len(words)) if words[k : k + len(must)] == must)
            places: dict[bytes, list[int]] = {}
            for k, w in enumerate(words):
                places.setdefault(w, []).append(k)
            rare = sorted(places, key=lambda w: (-self.weight[w], w))
            self.templates.append((label, words, must, at, places, rare, sum(self.weight[w] for w in words)))

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Places of base phrases, their labels, labels of templates, and the best share of a template's rarity.

        A base phrase alone has the share 1 of itself.
        """
        present = self.weight.keys() & words if len(words) < 64 else set(filter(self.weight.__contains__, words))
        if not present:
            return [], set(), set(), 0.0
        base = [x for x in self.base if present.issuperset(x[1])]
        templates = [x for x in self.templates if present.issuperset(x[2])]
        if not base and not templates:
            return [], set(), set(), 0.0
        places: dict[bytes, list[int]] = {}
        for k, w in enumerate(words):
            if w in present:
                places.setdefault(w, []).append(k)
        starts, base_labels, labels, score = [], set(), set(), 0.0
        for label, phrase in base:
            found = [k for k in places[phrase[0]] if words[k : k + len(phrase)] == phrase]
            if found:
                starts += found
                base_labels.add(label)
                score = 1.0
        for label, text, must, at, own, rare, total in templates:
            anchors = [w for w in rare if w in present][:ANCHORS]
            agreed: dict[int, int] = {}
            for w in anchors:
                for shift in {p - k for p in places[w] for k in own[w]} if len(own[w]) > 1 else (p - own[w][0] for p in places[w]):
                    agreed[shift] = agreed.get(shift, 0) + 1
            best = 0.0
            for shift, votes in agreed.items():
                if votes < min(2, len(anchors)):
                    continue
                around = range(shift + at - SLACK, shift + at + SLACK + 1)
                if any(k >= 0 and words[k : k + len(must)] == must for k in around):
                    there = sum(self.weight[w] for k, w in enumerate(text) if 0 <= shift + k < len(words) and words[shift + k] == w)
                    best = max(best, there / total)
            if best >= LEAST_SHARE:
                labels.add(label)
                score = max(score, best)
        return sorted(starts), base_labels, labels, score


def vocabulary(templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> set[bytes]:
    return {w for _, text, _ in templates for w in text.encode().split()} | {w for phrase in BASE for w in phrase.encode().split()}


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each template word occurs, and the number of documents: a row per template word."""
    known = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                for w in known.intersection(ascii_words(text.as_py())):
                    counts[w] = counts.get(w, 0) + 1
        words = ["", *(w.decode() for w in counts)]
        yield pa.record_batch([pa.array(words, pa.string()), pa.array([rows, *counts.values()], pa.int64())], names=["word", "n"])

    counted = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counted.collect()}
    documents = found.pop("", 0)
    return {w.encode(): n for w, n in found.items()}, documents


KIND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, text_col: str = "text", name: str | None = None) -> DataFrame:
    """``docs`` with a struct of ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Null and empty texts have no words and no labels; first and last word of none are null. Rows stay as they are.
    """
    frequency, documents = document_frequency(docs, text_col)
    index = Index(frequency, documents)
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    arrow = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())

    @F.arrow_udf(KIND)
    def scanned(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            words = ascii_words(text.as_py())
            starts, base, labels, score = index.scan(words)
            ends = (starts[0], starts[-1]) if starts else (None, None)
            rows.append((len(words), len(starts), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow, strict=True)], names=list(fields))

    return docs.withColumn(name or fresh(docs, "licence"), scanned(F.col(text_col)))
