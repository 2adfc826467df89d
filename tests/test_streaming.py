"""Streams fed in several goes equal their batch twins."""

from pyspark.sql import functions as F

from lorespan.operators import ledger, prose, search, telemetry
from lorespan.sources import corpus as corpus_source
from lorespan.sources.index_store import IndexStore
from lorespan.streaming import flows


def feed(spark, df, folder, order):
    """Writes a frame in two goes and yields after each."""
    half = df.orderBy(order).count() // 2
    rows = df.orderBy(order).collect()
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
        yield


def test_timeline_and_savings(spark, tmp_path):
    events = spark.sql(
        "SELECT id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0, id * 3000) AS ts, elt(1 + id % 3, 'search', 'read', 'init') AS event_type,"
        " cast(id % 7 AS double) AS tokens_saved, id % 4 AS session FROM range(200)"
    )
    folder = str(tmp_path / "in")
    for _ in feed(spark, events, folder, "id"):
        source = spark.readStream.schema(events.schema).parquet(folder)
        flows.drain(flows.timeline(source), flows.parquet_sink(str(tmp_path / "t")), str(tmp_path / "ct"), "update")
        calls = source.select("session", F.col("tokens_saved").cast("bigint").alias("saved"))
        flows.drain(flows.running_savings(calls), flows.parquet_sink(str(tmp_path / "s")), str(tmp_path / "cs"), "update")
    got = flows.latest(spark, str(tmp_path / "t"), "date string, tool string, call_count bigint, tokens_saved bigint", ["date", "tool"])
    daily = got.groupBy("date").agg(F.sum("call_count"), F.sum("tokens_saved")).orderBy("date")
    batch = telemetry.tool_timeline(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")), F.expr("timestamp_ntz'2024-01-20'"), 30)
    assert [tuple(r) for r in daily.collect()] == [tuple(r) for r in batch.collect()]
    totals = flows.latest(spark, str(tmp_path / "s"), "session bigint, session_saved bigint, calls bigint", ["session"])
    want = events.groupBy("session").agg(F.sum("tokens_saved").cast("bigint"), F.count("*"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, want.collect()))


def test_late_events_are_dropped(spark, tmp_path):
    schema = "event_type string, ts timestamp, tokens_saved double"
    folder = str(tmp_path / "in")
    run = lambda: flows.drain(
        flows.timeline(spark.readStream.schema(schema).parquet(folder)), flows.parquet_sink(str(tmp_path / "out")), str(tmp_path / "ck"), "update"
    )
    for day in ("2024-01-01", "2024-01-10", "2024-01-02"):  # the last is older than the watermark
        spark.sql(f"SELECT 'read' AS event_type, timestamp'{day} 12:00:00' AS ts, 1.0D AS tokens_saved").write.mode("append").parquet(folder)
        run()
    got = flows.latest(spark, str(tmp_path / "out"), "date string, tool string, call_count bigint, tokens_saved bigint", ["date", "tool"])
    assert sorted(r.date for r in got.collect()) == ["2024-01-01", "2024-01-10"]


def test_read_states(spark, tmp_path):
    reads = spark.sql(
        "SELECT id % 3 AS session, elt(1 + id % 2, 'a', 'b') AS file, id AS turn, CASE WHEN id % 11 = 0 THEN NULL ELSE cast(id div 9 % 2 AS string) END AS hash FROM range(120)"
    )
    folder = str(tmp_path / "in")
    for _ in feed(spark, reads, folder, "turn"):
        source = spark.readStream.schema(reads.schema).parquet(folder)
        flows.drain(flows.read_states(source), flows.parquet_sink(str(tmp_path / "out")), str(tmp_path / "ck"))
    got = spark.read.schema("session bigint, file string, turn bigint, state string, ref_turn bigint").parquet(str(tmp_path / "out"))
    want = ledger.read_states(reads, "session", F.floor(F.col("turn") / 10)).select("session", "file", "turn", "state", "ref_turn")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_index_feed(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index")).create()
    extract = {"symbols": prose.definitions, "call_lines": prose.call_lines, "imports": prose.imports}
    sink = flows.index_feed(store, 1, extract, lambda c: corpus_source.file_meta(c, F.lit(1.0)))
    schema = "file string, language string, content string"
    folder = str(tmp_path / "in")
    for rows in ([("a", "en", "One two\nThree"), ("b", "en", "Four")], [("a", "en", "Five six"), ("b", "en", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        flows.drain(spark.readStream.schema(schema).parquet(folder), sink, str(tmp_path / "ck"))
    assert [(r.file, r.name) for r in store.relation("symbols").collect()] == [("a", "Five")]
    assert [r.file for r in store.file_meta().collect()] == ["a"]
    # the feed keeps what searches and lookups read
    index = store.text_index()
    names = lambda q: [r.name for r in search.search(index, search.literal_terms(spark, q)).collect()]
    assert set(names("five")) == set(names("six")) == {"Five", "six"} and names("four one two") == []
    assert [tuple(r) for r in store.calls().collect()] == [("six", "a", 1, 0)]


def test_stream_without_input_has_an_empty_result(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("session bigint, saved bigint").parquet(str(tmp_path / "in"))
    flows.drain(flows.running_savings(source), flows.parquet_sink(str(tmp_path / "out")), str(tmp_path / "c"), "update")
    assert flows.latest(spark, str(tmp_path / "out"), "session bigint, session_saved bigint, calls bigint", ["session"]).collect() == []


def test_events_stored_as_a_folder(spark, tmp_path):
    from lorespan.plans.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_timeline", "stream_savings"):
        whole = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(map(tuple, whole.collect()))
