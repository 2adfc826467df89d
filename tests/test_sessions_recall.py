"""Session logs, turns and recall by similarity."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespan.operators import recall, transcripts
from lorespan.sources import memory_store, session_logs


def user(content, **more):
    return {"type": "user", "message": {"content": content}, **more}


def bot(*blocks, usage=None):
    message = {"content": list(blocks)}
    if usage is not None:
        message["usage"] = usage
    return {"type": "assistant", "message": message}


def tool(name, **inputs):
    return {"type": "tool_use", "name": name, "input": inputs}


TEXT = {"type": "text", "text": "hi"}
RECORDS = [
    {"type": "summary"},
    user([{"type": "tool_result"}], toolUseResult={"x": 1}),
    user("   "),
    user("  [1, 2] fix\nthe bug  ", sessionId="s-1"),
    bot(TEXT, tool("Read", file_path="a.py")),                                               # no usage: mark stays
    bot(tool("Read", file_path="a.py"), tool("index_resolve", symbol="f"), usage={"input_tokens": 3, "cache_creation_input_tokens": 4, "cache_read_input_tokens": 5, "output_tokens": 6}),
    bot(tool("Bash"), usage={"input_tokens": 10}),                                             # no message since
    user([{"type": "tool_result"}, {"type": "tool_result"}]),
    bot(tool("index_read", file="b.py"), usage={"output_tokens": 1}),
    user("first"),
    user([{"type": "text", "text": "second " + "x" * 200}, {"type": "text", "text": "third"}], sessionId="s-2"),
    user([{"type": "image"}]),                                                                 # neither text nor result
    bot(TEXT, usage={}),
    bot(tool("Read", file_path="c.py"), tool("index_resolve", symbol=""), usage={"input_tokens": 1}),
    user(""),
    bot(usage={"input_tokens": 2}),
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs") / "project"
    folder.mkdir()
    lines = [json.dumps(r) for r in RECORDS]
    (folder / "one.jsonl").write_text("\n".join([lines[0], "", "not json", "{bad", *lines[1:]]) + "\n")
    raw = session_logs.read_logs(spark, str(folder))
    assert {(r.session, r.project) for r in raw.select("session", "project").distinct().collect()} == {("one", "project")}
    with pytest.raises(Exception):
        session_logs.parse_records(raw, strict=True).select(F.to_json("rec")).collect()
    return session_logs.parse_records(raw).select("session", "pos", "rec")


def test_digest(records):
    r = transcripts.session_digest(records).first()
    assert r.task_text == "[1, 2] fix\nthe bug"
    assert r.files_read == ["a.py", "b.py", "c.py"]
    assert r.symbols_resolved == ["f"]
    assert r.session_id == "s-1"


@pytest.mark.parametrize("block", [10_000, 1, 2])
def test_turns(records, monkeypatch, block):
    monkeypatch.setattr(transcripts, "BLOCK_RECORDS", block)
    got = [tuple(r)[2:] for r in transcripts.turns(records).orderBy("pos").collect()]
    long = ("second " + "x" * 200 + " third")[:120]
    assert got == [
        ("  [1, 2] fix the bug  ", ["Read", "index_resolve"], 7, 5, 12, 6),
        ("(no user message)", ["Bash"], 10, 0, 10, 0),
        ("[tool result ×2]", ["index_read"], 0, 0, 0, 1),
        (long, ["Read", "index_resolve"], 1, 0, 1, 0),
        ("(no user message)", [], 2, 0, 2, 0),
    ]


def test_totals_and_classes(records):
    t = transcripts.turns(records)
    assert tuple(transcripts.session_totals(t).first())[1:] == (5, 20, 5, 25, 7)
    assert {r.turn_class: (r.turns, r.avg_new_tokens) for r in transcripts.turn_classes(t).collect()} == {"indexed": (3, 8 / 3), "native": (1, 10.0)}


def test_listing(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    logs = spark.createDataFrame([("p", "a", at(1)), ("p", "b", at(3)), ("q", "c", at(2))], "project string, session string, mtime timestamp")
    assert [r.session for r in session_logs.list_sessions(logs).collect()] == ["b", "c", "a"]
    assert [r.session for r in session_logs.list_sessions(logs, "p", 1).collect()] == ["b"]
    assert {(r.project, r.session) for r in session_logs.latest_per_project(logs).collect()} == {("p", "b"), ("q", "c")}


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} bigint, vec array<float>")


def test_similarity(spark, monkeypatch):
    rng = np.random.default_rng(1)
    q, s = rng.normal(size=(7, 5)), rng.normal(size=(40, 5))
    s[3] = 0
    monkeypatch.setattr(recall, "QUERY_BLOCK", 2)  # several blocks
    monkeypatch.setattr(recall, "STORED_BLOCK", 7)
    got = recall.similarities(
        vectors(spark, [(i, v.tolist()) for i, v in enumerate(q)], "query_id"), vectors(spark, [(i, v.tolist()) for i, v in enumerate(s)], "id")
    ).collect()
    assert len(got) == 280
    for r in got:
        a, b = q[r.query_id].astype(np.float32).astype(float), s[r.id].astype(np.float32).astype(float)
        want = 0.0 if r.id == 3 else a @ b / math.sqrt((a @ a) * (b @ b))
        assert r.similarity == pytest.approx(want, abs=5.1e-5)


def test_threshold_and_ties(spark):
    stored = vectors(spark, [(5, [2.0, 0.0]), (2, [1.0, 0.0]), (9, [0.0, 1.0])], "id")
    q = vectors(spark, [(0, [1.0, 0.0]), (1, [-1.0, -1.0]), (2, [0.4, math.sqrt(1 - 0.16)])], "query_id")
    best = {r.query_id: (r.id, r.similarity) for r in recall.best_match(q, stored).collect()}
    assert best == {0: (2, 1.0), 2: (9, 0.9165)}
    ranked = recall.ranking(q, stored).filter("query_id = 2").collect()
    assert [(r.id, r.accepted) for r in ranked] == [(9, True), (2, True), (5, True)]  # 0.40 is enough


def test_nearest_per_query(spark, monkeypatch):
    """The k nearest over all blocks, ties by id; vectors of another length and null ones take no part."""
    monkeypatch.setattr(recall, "QUERY_BLOCK", 3)
    monkeypatch.setattr(recall, "STORED_BLOCK", 4)
    rng = np.random.default_rng(2)
    q, s = rng.integers(-2, 3, size=(8, 3)), rng.integers(-2, 3, size=(60, 3))
    stored = vectors(spark, [(i, v.astype(float).tolist()) for i, v in enumerate(s)] + [(100, [1.0]), (101, None), (102, [])], "id").repartition(3)
    asked = vectors(spark, [(i, v.astype(float).tolist()) for i, v in enumerate(q)] + [(50, None)], "query_id")
    every = {}
    for r in recall.similarities(asked, stored).collect():
        every.setdefault(r.query_id, []).append((-r.similarity, r.id))
    assert {i: len(x) for i, x in every.items()} == {i: 60 for i in range(8)}
    got = {}
    for r in recall.ranking(asked, stored, k=5).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.id))
    assert got == {i: sorted(x)[:5] for i, x in every.items()}
    best = {r.query_id: (-r.similarity, r.id) for r in recall.best_match(asked, stored, 0.5).collect()}
    assert best == {i: min(x) for i, x in every.items() if min(x)[0] <= -0.5}
    assert recall.best_match(asked.limit(0), stored).collect() == recall.best_match(asked, stored.limit(0)).collect() == []


def test_hashed_words_are_placed_by_md5(spark):
    import hashlib

    df = spark.createDataFrame([("Parse the parser, été",), (None,), ("",)], "t string")
    got = [r.embedding for r in recall.hashed_embedding(df, "t", dim=32).collect()]
    counts = np.zeros(32)
    for word in ("parse", "the", "parser", "ete"):
        digest = hashlib.md5(word.encode()).hexdigest()
        counts[int(digest[:8], 16) % 32] += 1 if int(digest[8], 16) % 2 == 0 else -1
    assert got[0] == pytest.approx(counts / np.sqrt(counts @ counts), abs=1e-6)
    assert got[1] == got[2] == [0.0] * 32


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_a_log_is_read_in_ranges(spark, tmp_path, ends):
    """Line numbers of logs that many tasks read equal those of the whole file; lines cross the ranges' ends."""
    rng = np.random.default_rng(4)
    logs = {}
    for name, n in (("a", 9000), ("b", 40), ("empty", 0)):
        (tmp_path / "p").mkdir(exist_ok=True)
        logs[name] = ["" if x % 17 == 0 else f"{name} {i} " + "x" * int(x) for i, x in enumerate(rng.integers(0, 300, n))]
        (tmp_path / "p" / f"{name}.jsonl").write_bytes("".join(line + ends for line in logs[name]).encode())
    (tmp_path / "p" / "open.jsonl").write_bytes(f"one{ends}two".encode())
    logs["open"] = ["one", "two"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = session_logs.read_logs(spark, str(tmp_path / "p"))
        assert found.rdd.getNumPartitions() > 20
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        assert r.project == "p"
        got.setdefault(r.session, {})[r.pos] = r.raw
    assert got == {name: dict(enumerate(lines)) for name, lines in logs.items() if lines}
    assert len(rows) == sum(map(len, logs.values()))


def test_encoders_and_memory(spark, tmp_path):
    df = spark.createDataFrame([("s1", "fix the parser", ["a.py"], ["f"], "x"), ("s2", "", [], [], None)], "session string, task_text string, files_read array<string>, symbols_resolved array<string>, session_id string")
    hashed = recall.hashed_embedding(df, "task_text", dim=16)
    norms = [math.sqrt(sum(x * x for x in r.embedding)) for r in hashed.orderBy("session").collect()]
    assert norms == pytest.approx([1.0, 0.0])
    own = recall.encode(df, "task_text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert [r.embedding for r in own.orderBy("session").collect()] == [[14.0, 1.0], [0.0, 1.0]]
    path = str(tmp_path / "memory")
    rows = memory_store.as_memory(hashed, F.monotonically_increasing_id(), "embedding", F.lit("2024-01-01"))
    memory_store.insert(rows, path)
    memory_store.insert(rows.filter("session_id = 'x'"), path)
    listed = recall.session_list(memory_store.load(spark, path)).collect()
    assert len(listed) == 3 and sorted(r.n_files for r in listed) == [0, 1, 1]
    memory_store.clear(spark, path)
    assert memory_store.load(spark, path).count() == 0
