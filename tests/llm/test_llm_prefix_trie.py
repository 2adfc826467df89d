import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from llm_rows import as_tuples

from lorespan.llm import prefix_trie, turns
from lorespan.llm.oracle import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, place string, ends string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", "p", "e") for r in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, text))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        rebuilt[c] = own.get(c - base, [])[:h] + x[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    out = []
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in members[node] if len(rebuilt[c]) == len(node))
        out.append((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=3):
    """Few texts, so that prefixes are shared; bases, missing bases, one long conversation and its copies."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 140), *range(201, 220), 300, *range(-3, 0), *range(-101, -99)]:
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randrange(1, 3)) for t in range(rng.randrange(1, 9))]
    long = [(t, "user" if t % 2 else "assistant", f"turn {t % 7} é") for t in range(300)]
    rows += [(c, *x) for c in (450, 451, 452, 777) for x in long]
    rows += [(500, 0, None, None), (500, None, "user", "first"), (500, None, "user", ""), (501, 1, "user", "tied"), (501, 1, "user", "tied"), (501, 1, "assistant", "tied")]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None), (502, 0, "user", "x" * 200_000), (503, 0, "u", "serx"), (504, 0, "us", "erx")]
    return rows


@pytest.fixture(scope="module")
def wanted():
    return brute(conversations())


def test_equals_brute_force(spark, wanted):
    found = prefix_trie.prefix_trie(table(spark, conversations()))
    assert found.columns == COLUMNS
    assert as_tuples(found) == wanted


def test_conversations_spread_over_partitions_and_blocks(spark, wanted, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert as_tuples(prefix_trie.prefix_trie(table(spark, conversations()).repartition(5))) == wanted
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_colliding_fingerprints_are_noticed_and_drawn_again(spark, monkeypatch):
    rows = [(c, t, "user", x) for c, texts in ((11, "ab"), (12, "ba"), (13, "abc")) for t, x in enumerate(texts)]
    drawn, sound = [], prefix_trie.multipliers

    def weak(attempt):
        drawn.append(attempt)
        return (1, 1) if attempt == 0 else sound(attempt)  # R = 1 forgets the order of turns

    monkeypatch.setattr(prefix_trie, "multipliers", weak)
    monkeypatch.setattr(prefix_trie, "head_length", lambda c: c.cast("int") * 0)
    monkeypatch.setattr("zlib.crc32", lambda x: 0)
    assert as_tuples(prefix_trie.prefix_trie(table(spark, rows))) == brute(rows)
    assert drawn == [0, 1]


def test_equal_digests_of_different_texts_are_noticed(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(turns, "digest", lambda role, text: F.unhex(F.sha2(F.substring(text, 1, 1), 256)))
    rows = [(1, 0, "user", "ab"), (2, 0, "user", "ac")]
    taken = iter([(5, 7), (9, 11)])
    monkeypatch.setattr(prefix_trie, "multipliers", lambda attempt: next(taken))
    monkeypatch.setattr(prefix_trie, "head_length", lambda c: c.cast("int") * 0)
    with pytest.raises(StopIteration):  # every draw fails, none is accepted
        prefix_trie.prefix_trie(table(spark, rows))


def test_empty_tables(spark):
    assert prefix_trie.prefix_trie(table(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "a", "b")])).collect() == []


def test_sql_equals_brute_force(spark, wanted):
    connection = duckdb.connect()
    rows = conversations()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_prefix_trie']})").fetchall()
    assert sorted(found, key=repr) == wanted
