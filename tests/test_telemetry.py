"""Event log aggregates at their edges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lorespan import schemas
from lorespan.operators import economy, telemetry
from lorespan.sources import event_log


def as_of():
    return F.expr("timestamp_ntz'2024-03-31 12:00:00'")



def at(s):
    return dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc).timestamp()


def event(i, kind, when, duration=1.0, **meta):
    return (i, kind, at(when), duration, json.dumps(meta))


LOG = [
    event(1, "search", "2024-03-01 11:59:59", tokens_saved=5, output_tokens=10),
    event(2, "search", "2024-03-01 12:00:00", tokens_saved=7, output_tokens=11),
    event(3, "search", "2024-03-30 23:59:59", tokens_saved=12.7, output_tokens=2.25),
    event(4, "resolve", "2024-03-31 00:00:00", query="f", tokens_saved="8"),
    event(5, "resolve", "2024-03-31 00:00:01", query="f"),
    event(6, "resolve", "2024-03-31 00:00:02", query="g", tokens_saved=None),
    event(7, "resolve", "2024-03-31 00:00:02"),
    event(8, "recall", "2024-03-31 01:00:00", tokens_saved=1),
    event(9, "recall", "2024-03-31 01:00:00", tokens_saved=0),
    event(10, "recall", "2024-03-31 01:00:00", tokens_saved=0),
    event(11, "init", "2024-03-31 02:00:00", 100.0, files_indexed=3, files_skipped=1, symbols=9, incremental=False),
    event(12, "update", "2024-03-31 03:00:00", 5.0, files_indexed=0, files_skipped=4, symbols=0, incremental=True),
    (13, "search", at("2024-03-31 04:00:00"), None, "not json"),
]


@pytest.fixture(scope="module")
def events(spark):
    return telemetry.parse_events(spark.createDataFrame(LOG, schemas.EVENTS))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tool_summary(events):
    assert rows(telemetry.tool_summary(events)) == [("resolve", 4, 8), ("search", 4, 24), ("recall", 3, 1)]


def test_timeline_starts_at_the_exact_instant(events):
    assert rows(telemetry.tool_timeline(events, as_of(), 30)) == [("2024-03-01", 1, 7), ("2024-03-30", 1, 12), ("2024-03-31", 8, 9)]
    with pytest.raises(ValueError):
        telemetry.tool_timeline(events, as_of(), 0)


def test_history(events):
    got = telemetry.index_history(events).collect()
    assert [r.id for r in got] == [12, 11]
    assert (got[1].files_indexed, got[1].files_skipped, got[1].symbols, got[1].incremental) == (3, 1, 9, "false")


def test_savings(events):
    assert telemetry.savings_total(events).first()[0] == 33
    assert rows(telemetry.savings_by_tool(events)) == [("search", 24), ("resolve", 8), ("recall", 1)]
    assert rows(telemetry.savings_cumulative(events)) == [("2024-03-01", 12), ("2024-03-30", 24), ("2024-03-31", 33)]


def test_empty_log(spark):
    none = telemetry.parse_events(spark.createDataFrame([], schemas.EVENTS))
    assert telemetry.savings_total(none).first()[0] == 0
    assert rows(telemetry.recall_hit_rate(none, "recall")) == [(0, 0, 0, 0.0)]


def test_heatmap_fans_out(spark, events):
    symbols = spark.createDataFrame([("f", "b.py", 1, "function"), ("f", "a.py", 7, "class"), ("f", "a.py", 9, "method")], "name string, file string, start_line int, kind string")
    got = rows(telemetry.heatmap(events, symbols, "resolve"))
    assert got == [("f", 6, 2, "a.py", "class"), ("g", 1, 1, None, None)]
    assert len(rows(telemetry.heatmap(events, symbols, "resolve", limit=1))) == 1


def test_hit_rate(events):
    assert rows(telemetry.recall_hit_rate(events, "recall")) == [(3, 1, 2, 33.3)]


def test_response_size(events):
    assert rows(telemetry.response_size(events)) == [("search", 7.8)]
    assert rows(telemetry.response_trend(events, as_of())) == [("search", "2024-03-01", 11.0), ("search", "2024-03-30", 2.3)]
    nested = telemetry.response_size_with_trend(events, as_of()).first()
    assert [tuple(x) for x in nested.trend] == [("2024-03-01", 11.0), ("2024-03-30", 2.3)]


def test_cost(spark):
    df = spark.createDataFrame([(1_500_000,), (499,)], "t bigint")
    assert rows(telemetry.cost_estimate(df, "t")) == [(1_500_000, 7.5, 1500, 1500.0), (499, 0.0025, 0, 0.5)]


def test_metadata_builder(spark):
    df = spark.createDataFrame([(1, "x" * 300, 0), (2, "", 3), (3, None, 0)], "n bigint, q string, m bigint")
    one = F.lit(1)
    out = df.select("n", telemetry.tool_metadata(F.col("n"), one, one, one, F.col("q"), F.col("m"), F.lit(0)).alias("j")).orderBy("n").collect()
    docs = [json.loads(r.j) for r in out]
    assert len(docs[0]["query"]) == 200 and "matched_files" not in docs[0]
    assert "query" not in docs[1] and docs[1]["matched_files"] == 3
    assert set(docs[2]) == {"result_count", "output_tokens", "naive_tokens", "tokens_saved"}


def test_index_run_event(spark):
    stats = spark.createDataFrame([(3, 1, 9, 0.5)], "files_indexed bigint, files_skipped bigint, symbols bigint, elapsed double")
    r = telemetry.index_run_event(stats, True, as_of()).first()
    assert (r.event_type, r.duration_ms) == ("update", 500.0)
    assert json.loads(r.metadata) == {"files_indexed": 3, "files_skipped": 1, "symbols": 9, "incremental": True}


def test_event_log_appends_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1, 23, 59), 1.0, "{}"), (2, "b", dt.datetime(2024, 1, 2), 1.0, "{}")], "id bigint, event_type string, ts timestamp_ntz, duration_ms double, metadata string")
    event_log.append_events(one, path, "a")
    event_log.append_events(one.orderBy("ts").limit(1), path, "b")
    event_log.append_events(one, path, "a")  # a repeated run replaces itself
    got = event_log.read_events(spark, path).groupBy("date").count().orderBy("date").collect()
    assert [(str(r.date), r["count"]) for r in got] == [("2024-01-01", 2), ("2024-01-02", 1)]


def test_saved_never_negative(spark):
    df = spark.createDataFrame([(10, 3), (3, 10)], "naive bigint, out bigint")
    assert sorted(r.s for r in df.select(economy.saved(F.col("naive"), F.col("out")).alias("s")).collect()) == [0, 7]


def test_event_log_of_many_runs(spark, tmp_path):
    """Appended again, a run replaces all its days; compaction changes nothing but the number of files."""
    from lorespan.sources import event_log

    path = str(tmp_path / "log")

    def rows(run, days):
        return spark.createDataFrame([(run * 100 + d, "t", dt.datetime(2024, 1, d, 23, 59), 1.0, "{}") for d in days], "id long, event_type string, ts timestamp_ntz, duration_ms double, metadata string")

    def ids():
        return sorted(r.id for r in event_log.read_events(spark, path).collect())

    for run, days in ((1, (1, 2, 3)), (2, (2, 9)), (3, (1, 5))):
        event_log.append_events(rows(run, days), path, f"run {run}")
    event_log.append_events(rows(1, (2,)), path, "run 1")
    want = [102, 202, 209, 301, 305]
    assert ids() == want
    for day in ("2024-01-03", "2024-01-06"):
        event_log.compact(spark, path, day)
        assert ids() == want
    event_log.append_events(rows(4, (9,)), path, "run 4")
    assert ids() == [102, 202, 209, 301, 305, 409]
    compacted = [p for p in (tmp_path / "log/events").glob("date=2024-01-0[1-5]/run=r/attempt=*")]
    assert len(compacted) >= 3
    assert event_log.read_events(spark, path).filter("date = date'2024-01-09'").count() == 2
    with pytest.raises(ValueError):
        event_log.append_events(rows(5, (9,)), path, "")
