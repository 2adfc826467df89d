import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import documents, empty, odd_rows
from tokenizers import Tokenizer

from lorespan.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def check(found, rows, window):
    """Every id of every row in one piece, gapless sequences of full or power-of-two length; returns the sequences."""
    sequences, pieces = defaultdict(list), Counter()
    for r in found:
        assert 0 < r.length <= window
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0 and at < window
    # each row's ids can be read off the pieces: walk from start to start
    for doc_id, text, *_ in rows:
        ids, at = ids_of(text), 0
        while at < len(ids):
            n = next(n for (d, s, n, c, t), left in pieces.items() if left and d == doc_id and s == at and t == len(ids) and c == crc(ids[at : at + n]))
            pieces[doc_id, at, n, crc(ids[at : at + n]), len(ids)] -= 1
            at += n
        assert at == len(ids)
    assert not sum(pieces.values())
    return sequences


@pytest.mark.parametrize("window", [2048, 64])
def test_every_id_lies_in_one_piece(spark, window):
    rows = odd_rows()
    check(packing.pack(documents(spark, rows).repartition(3), PATH, window=window).collect(), rows, window)


def test_small_shards_go_on_in_open_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 3)
    rows = odd_rows(3)
    sequences = check(packing.pack(documents(spark, rows).coalesce(1), PATH, window=32).collect(), rows, 32)
    tasks = {s >> 33 for s in sequences}
    assert sum(sum(r.length for r in x) < 32 for x in sequences.values()) <= 5 * len(tasks)


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).collect() == []


def test_frequencies_are_those_of_the_corpus(spark):
    rows = odd_rows()
    tokens = packing.encoded(documents(spark, rows).repartition(4), PATH, "doc_id", "text", 1)
    counts = packing.document_frequencies(tokens)
    wanted = Counter(t for _, text, _ in rows for t in set(ids_of(text)))
    assert {n: c for n, c in enumerate(counts.tolist()) if c} == dict(wanted)
    assert tokens.filter("ids IS NOT NULL").count() == len(rows)


def test_index_returns_unused_documents_by_bm25():
    rng = random.Random(8)
    docs = [[rng.randrange(60) for _ in range(rng.randrange(1, 50))] for _ in range(40)]
    df = Counter(t for d in docs for t in set(d))
    idf = packing._idf(np.array([df[t] for t in range(60)]), len(docs))
    mean = sum(map(len, docs)) / len(docs)
    index = packing.Shard([np.array(d, dtype="<u2") for d in docs], idf, mean)
    for seed in range(40):
        index.unused[:] = True
        index.unused[[seed, (seed * 7) % 40]] = False
        asked = sorted(set(docs[seed]), key=lambda t: (-idf[t], t))[: packing.ASKED]
        scores = {}
        for n, d in enumerate(docs):
            if index.unused[n]:
                tf = Counter(d)
                scores[n] = sum(math.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in asked if t in tf)
        ranked = index.nearest(np.array(sorted(set(docs[seed]))))
        assert sorted(ranked.tolist()) == sorted(scores)
        found = [scores[n] for n in ranked.tolist()]
        assert all(a >= b - 1e-4 for a, b in zip(found, found[1:], strict=False))


def test_near_documents_share_sequences(spark):
    rng = random.Random(1)
    topics = [[f"{a}{n}zq" for n in range(30)] for a in ("lion", "boat", "wheat")]
    rows = [(n, " ".join(rng.choice(topics[n % 3]) for _ in range(12)), "s") for n in range(90)]
    sequences = check(packing.pack(documents(spark, rows).coalesce(1), PATH, window=256).collect(), rows, 256)
    mixed = sum(len({r.doc_id % 3 for r in own}) > 1 for own in sequences.values() if len(own) > 1)
    assert mixed <= len(sequences) // 3
