import itertools
import random

import numpy as np
import pytest
import xxhash
from llm_rows import as_tuples, documents, empty, odd_rows, sentence
from pyspark.sql import functions as F

from lorespan.llm import simhash


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    prints = [fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            root[top(a)] = top(b)
    groups = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            groups[top(k)] = min(i, groups.get(top(k), i))
    return sorted(((i, f"{prints[k]:016x}", groups.get(top(k))) for k, (i, _, _) in enumerate(rows)), key=repr)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    base = sentence(rng, 300).split()
    rows = odd_rows()
    for n in range(40):  # copies with few changed words, so that some fingerprints differ in a bit or two
        copy = list(base)
        copy[rng.randrange(300)] = f"new{n}"
        rows.append((200 + n, " ".join(copy), "s0"))
    assert as_tuples(simhash.near_duplicates(documents(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.one_of_each_group(empty(spark)).collect() == []


@pytest.mark.parametrize("radius", [0, 2, 7, 46])
def test_planes_find_the_links_of_pairs(radius):
    rng = np.random.default_rng(radius)
    words = rng.integers(0, 2**63, size=(6, 2), dtype=np.uint64)[rng.integers(0, 6, 333)]
    for k in range(len(words)):
        for bit in rng.integers(0, 128, rng.integers(0, radius + 3)):
            words[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= radius

    def groups(links):
        root = list(range(len(words)))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return [top(x) for x in range(len(words))]

    forest = list(simhash.Planes(words, radius).forest())
    assert all(near[a, b] for a, b in forest)
    assert groups(forest) == groups(np.argwhere(near).tolist())


def test_buckets_over_the_limit_lose_no_link(spark, monkeypatch):
    rng = random.Random(5)
    fps = {rng.getrandbits(63) for _ in range(3)}
    fps |= {f ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(16)) for f in list(fps) * 60}
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole = as_tuples(simhash.components(simhash.links(classes, "fp", simhash.pigeonhole_keys(F.col("fp"), 2), ["fp"], 2)))
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", 16)
    assert as_tuples(simhash.components(simhash.links(classes, "fp", simhash.pigeonhole_keys(F.col("fp"), 2), ["fp"], 2))) == whole


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101)], "a long, b long")
    assert as_tuples(simhash.components(chain)) == sorted([(n, 0) for n in range(61)] + [(100, 100), (101, 100)], key=repr)


def test_one_of_each_group_keeps_the_least_id_and_all_columns(spark):
    rng = random.Random(8)
    base = sentence(rng, 400).split()
    near = list(base)
    near[200] = "changed"
    other = sentence(rng, 400)
    rows = [(30, " ".join(base), "s0"), (20, " ".join(near), "s1"), (10, other, "s2"), (10, other, "s2"), (40, None, None), (41, "", "s1"), (None, other, "s3")]
    docs = documents(spark, rows)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10, 20, 40]


def test_unlike_texts_stay(spark):
    rng = random.Random(9)
    rows = [(n, sentence(rng, 200), "s0") for n in range(60)]
    assert simhash.one_of_each_group(documents(spark, rows)).count() == 60


@pytest.mark.parametrize("radius", [0, 2, 9])
def test_small_buckets_through_shared_planes(radius):
    """Buckets of 1 to 64 members in one set of planes give the links of their pairs, and none across buckets."""
    rng = np.random.default_rng(radius)
    sizes = rng.integers(1, 65, 300)
    words = rng.integers(0, 2**63, size=(5, 1), dtype=np.uint64)[rng.integers(0, 5, sizes.sum())]
    for k in range(len(words)):
        for bit in rng.integers(0, 64, rng.integers(0, radius + 3)):
            words[k, 0] ^= np.uint64(1 << int(bit))
    edges = list(simhash.small_bucket_links(words, sizes, radius))
    at = 0
    for size in sizes.tolist():
        own = [(a - at, b - at) for a, b in edges if at <= a < at + size]
        assert all(0 <= a < size and 0 <= b < size for a, b in own)
        near = np.bitwise_count(words[at : at + size] ^ words[None, at : at + size, 0]) <= radius
        assert all(near[a, b] for a, b in own)
        assert groups_of(size, own) == groups_of(size, np.argwhere(near).tolist())
        at += size


def groups_of(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def test_every_link_comes_through_the_counters_and_far_blocks_are_abandoned(spark, monkeypatch):
    added = []
    plain = simhash._Counters.add

    def add(self, x, k=0):
        added.append(len(x))
        return plain(self, x, k)

    monkeypatch.setattr(simhash._Counters, "add", add)
    far = np.array([[0], [(1 << 64) - 1]], dtype=np.uint64)
    assert list(simhash.small_bucket_links(far, np.array([2]), 2)) == []
    assert len(added) == 16  # given up after the first sixteen planes
    added.clear()
    assert list(simhash.small_bucket_links(np.array([[5], [7]], dtype=np.uint64), np.array([2]), 2)) == [(0, 1)]
    assert len(added) == 64
    added.clear()
    wide = np.zeros((200, 1), dtype=np.uint64)
    wide[1:, 0] = np.uint64((1 << 64) - 1)
    assert len(list(simhash._bucket_links(wide, [0, 200], 2))) == 198 and added


def test_a_component_across_split_buckets_and_a_hub(spark, monkeypatch):
    """A hub within the radius of many others, in buckets that are split, is one component; so is a chain."""
    rng = random.Random(21)
    hub = rng.getrandbits(62)
    fps = [hub, *{hub ^ (1 << a) ^ (1 << b) for a in range(0, 62, 3) for b in range(1, 62, 5) if a != b}]
    chain = [rng.getrandbits(62)]
    for n in range(60):
        chain.append(chain[-1] ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)))
    classes = spark.createDataFrame([(f,) for f in {*fps, *chain}], "fp long")
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", 32)
    found = {r.node: r.root for r in simhash.components(simhash.links(classes, "fp", simhash.pigeonhole_keys(F.col("fp"), 2), ["fp"], 2)).collect()}
    assert len({found[f] for f in fps}) == 1
    assert len({found[f] for f in chain}) == 1


def test_one_of_each_group_equals_brute_force(spark):
    rng = random.Random(17)
    base = sentence(rng, 300).split()
    rows = odd_rows()
    for n in range(30):
        copy = list(base)
        copy[rng.randrange(300)] = f"new{n}"
        rows.append((500 - n, " ".join(copy), "s0"))
    rows.append((600, sentence(rng, 60_000), "s1"))  # a very long text alone
    want = {c for i, _, c in brute(rows) if c is not None}
    kept = [r.doc_id for r in simhash.one_of_each_group(documents(spark, rows)).collect() if r.doc_id is not None]
    assert set(kept) == want and len(kept) == len(want) + 1  # two texts of one id are two documents
