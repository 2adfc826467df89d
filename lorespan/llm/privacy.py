"""Personal data, and the terms that give it away.

Addresses and numbers of known form are the protected entities. Over the whole corpus, terms are counted
beside entities, and a term's disclosure of an entity is its pointwise mutual information with it as a share of
the entity's information content: 1 for a term that never occurs without the entity. Pairs count that chance would
hardly make: the bound on the probability that so many texts hold them, times all pairs, is below one. Terms over the
threshold are removed, or generalised where they disclose less.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.common import ascii_words, fresh, stored

# Kinds in their order, and their patterns. Possessive runs and the look-behind keep the matches and
# make long runs linear.
KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
EMAIL_LOCAL = string.ascii_letters + string.digits + "._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Words on either side of an entity that count as beside it; None for the whole text.
WINDOW: int | None = 8
#: Letters of a term at least.
LEAST_LETTERS = 1
#: Pairs of all that may be rated though chance made them. One text alone says nothing about occurring together.
BY_CHANCE, LEAST_TEXTS = 1.0, 2
GENERALISE, REMOVE = 0.9, 0.97
#: Bits of the filter that tells which words may be terms; its size does not grow with the corpus.
FILTER_BITS = 1 << 22


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address has one @; what stands before it as far back as letters of an address go, after it a domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[max(done, at - 64) : at]
        kept = before.rstrip(EMAIL_LOCAL)
        if not kept and at - 64 > done:
            before = text[done:at]
            kept = before.rstrip(EMAIL_LOCAL)
        local = len(before) - len(kept)
        domain = EMAIL_DOMAIN.match(text, at + 1) if local else None
        if domain:
            done = domain.end()
            yield at - local, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, rank of kind, end)`` in order; null and empty texts have none."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text) if "." in text else ():
            # digits without leading zeros, as long numbers are no integers of Python's
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def beside(text: str, spans: list[tuple[int, int, int]], window: int | None = WINDOW, letters: int = LEAST_LETTERS) -> set[tuple[str, str]]:
    """``(entity, term)`` pairs: words within the window of an entity, outside all entities. Words are found once."""
    words, covered, at = [], 0, 0
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            covered = max(covered, spans[at][2])
            at += 1
        if m.start() >= covered:
            words.append((m.start(), m.end(), m[0]))
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    reach, out = len(words) if window is None else window, set()
    for start, rank, end in spans:
        entity = f"{KINDS[rank]}:{text[start:end].lower()}"
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        out.update((entity, _term(w[2])) for w in [*words[max(0, left - reach) : left], *words[right : right + reach]] if len(w[2]) >= letters)
    return out


def _term(word: str) -> str:
    return word.encode().lower().decode()


SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))
_PAIRS = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))


def _entities(text: Column) -> Column:
    @F.arrow_udf(f"spans {SPANS}, pairs array<struct<entity:string,term:string>>")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            text = x.as_py()
            spans = base_spans(text)
            pairs = sorted(beside(text, spans)) if spans else []
            rows.append({"spans": [dict(zip(("start", "rank", "end"), s, strict=True)) for s in spans], "pairs": [{"entity": e, "term": t} for e, t in pairs]})
        return pa.array(rows, pa.struct([("spans", _SPANS), ("pairs", _PAIRS)]))

    return found(text)


class WordFilter:
    """A fixed number of bits by word hash: says no to most words that are not among the given ones."""

    def __init__(self, words: DataFrame):
        slot = F.crc32(F.encode("term", "UTF-8")) % FILTER_BITS
        cells = words.select((slot / 64).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(crc32(encode(term, 'UTF-8')) % {FILTER_BITS} % 64 as int))").alias("bit"))
        self.bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
        # at most FILTER_BITS / 64 rows
        for cell, bits in cells.groupBy("cell").agg(F.bit_or("bit")).collect():
            self.bits[cell] = bits
        self.bits = self.bits.tobytes()

    def __call__(self, word: bytes) -> int:
        slot = zlib.crc32(word) % FILTER_BITS
        return self.bits[slot >> 3] >> (slot & 7) & 1


def term_frequency(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, n)``: in how many documents each of ``terms`` occurs, counted where the documents lie first."""
    known = WordFilter(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for w in filter(known, set(ascii_words(text.as_py()))):
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = {}
        yield _counted(counts)

    counted = docs.select(text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counted.join(terms, "term", "left_semi")


def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])


def disclosing_terms(docs: DataFrame, found: DataFrame, by_chance: float = BY_CHANCE, generalise: float = GENERALISE, text_col: str = "text") -> DataFrame:
    """``(term, disclosure)``: terms that tell more of some entity than the threshold allows.

    ``found``: ``(key, pairs)`` per document, key the same for equal texts. Copies of a text support a pair once;
    frequencies are of documents. Were they independent, k or more texts would hold a pair that is l times as frequent as
    expected with a probability of at most exp(-k (ln l - 1 + 1 / l)); this times the number of pairs may not exceed
    ``by_chance``.
    """
    pairs = found.filter(F.size("pairs") > 0).select("key", F.explode("pairs").alias("p")).select("key", "p.entity", "p.term")
    by_text = pairs.groupBy("entity", "term", "key").agg(F.count(F.lit(1)).alias("n"))
    both = by_text.groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts"))
    both = stored(both, "privacy_pairs")
    n_documents, least = float(found.count()), math.log(max(both.count(), 1) / by_chance)
    documents = F.lit(n_documents)
    surprise = lambda lift: F.when(lift > 1, F.col("texts") * (F.log(lift) - 1 + 1 / lift)).otherwise(0.0)
    # no term or entity is rarer than the pair, so the pair's own number bounds how surprising it can be
    both = both.filter((F.col("texts") >= LEAST_TEXTS) & (surprise(documents / F.col("both")) >= least))
    terms = stored(both.select("term").distinct(), "privacy_terms")
    if terms.isEmpty():
        return terms.withColumn("disclosure", F.lit(0.0))
    frequency = term_frequency(docs, terms, text_col)
    entities = found.filter(F.size("pairs") > 0).select(F.explode(F.array_distinct("pairs.entity")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    content = F.log(documents / F.col("n_entity"))
    mutual = F.log(documents * F.col("both") / (F.col("n_entity") * F.col("n")))
    lift = documents * F.col("both") / (F.col("n_entity") * F.col("n"))
    rated = both.join(entities, "entity").join(frequency, "term").filter(surprise(lift) >= least)
    rated = rated.withColumn("disclosure", F.when(content > 0, mutual / content).otherwise(0.0))
    return rated.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= generalise)


def _occurrences(docs: DataFrame, terms: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, start, end, term)`` of words that pass the filter of ``terms``; the join that follows is exact."""
    known = WordFilter(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends, found = [], [], [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = x.as_py()
                hit = set(filter(known, set(ascii_words(text))))
                for m in WORD.finditer(text) if hit else ():
                    if (w := m[0].encode().lower()) in hit:
                        keys.append(k)
                        starts.append(m.start())
                        ends.append(m.end())
                        found.append(w.decode())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.string())], names=["key", "start", "end", "term"])

    return docs.select(key, text_col).mapInArrow(run, "key string, start long, end long, term string")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, base, spans)`` per row; spans are ``(start, rank of kind, end)`` in code points, sorted.

    ``base`` are the entities; ``spans`` are these and all occurrences of disclosing terms that touch none of
    them. Equal texts have equal keys and spans. Null and empty texts have none; rows with null or repeated ids
    come back as often as they were given.
    """
    key = F.concat_ws(":", *(F.hex(F.xxhash64(F.lit(n), F.col(text_col))) for n in (1, 2)))
    read = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    found = read.withColumn("found", _entities(F.col("text"))).select("id", "key", F.col("found.spans").alias("base"), F.col("found.pairs").alias("pairs"))
    found = stored(found, "privacy_entities")
    terms = stored(disclosing_terms(read, found), "privacy_disclosing")
    if terms.isEmpty():
        return found.select(F.col("id").alias(id_col), "key", "base", F.col("base").alias("spans"))
    places = _occurrences(read, terms, "key", "text").join(terms, "term")
    rank = F.when(F.col("disclosure") >= REMOVE, 4).otherwise(5).cast("int")
    added = places.groupBy("key").agg(F.collect_set(F.struct("start", rank.alias("rank"), "end")).alias("added"))
    # rows without any such place pass by the join
    whole = found.join(added, "key", "left")
    apart = F.filter("added", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", apart)))
    return whole.select(F.col("id").alias(id_col), "key", "base", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``."""
    found = scan(docs, id_col, text_col)
    return found.select(id_col, *(_count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _count(rank: int) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")


def sanitised_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with entities and generalised terms as their class and removed terms left out."""
    out, at = [], 0
    for start, rank, end in spans:
        if start >= at:
            out += [text[at:start], "" if rank == 4 else f"[{KINDS[rank].upper() if rank < 4 else 'TERM'}]"]
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of the text; rows stay as they are."""
    names = fresh(docs, "text_key"), fresh(docs, "text_spans")
    spans = scan(docs, id_col, text_col).filter(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias(names[1])).withColumnRenamed("key", names[0])
    key = F.concat_ws(":", *(F.hex(F.xxhash64(F.lit(n), F.col(text_col))) for n in (1, 2)))

    @F.udf("string")
    def cleaned(text, spans):
        return sanitised_text(text, [(s.start, s.rank, s.end) for s in spans]) if spans else text

    wide = docs.withColumn(names[0], key).join(spans, names[0], "left")
    clean = F.when(F.col(names[1]).isNull(), F.col(text_col)).otherwise(cleaned(F.col(text_col), F.col(names[1])))
    return wide.withColumn(text_col, clean).select(*docs.columns)
