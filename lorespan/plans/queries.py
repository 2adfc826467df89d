"""Every operator bound to the tables of a data folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import text
from lorespan.operators import (
    economy, extract, ledger, lifecycle, overview, prose, recall, redact, resolve, search, telemetry, transcripts,
)
from lorespan.plans import bindings as b
from lorespan.session import scratch_dir, stored
from lorespan.sources import catalog, event_log, memory_store, session_logs
from lorespan.sources import corpus as corpus_source
from lorespan.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

POLICY = redact.Policy(enabled=True, entity_types=tuple(redact.DETECTORS))


def _plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that column types do not depend on the engine that counts."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
    return fn


def _as_of():
    return F.expr(f"timestamp_ntz'{b.AS_OF}'")


# ---------------------------------------------------------------- corpus and lifecycle

@query
def corpus_scan(spark, d):
    return b.scanned(spark, d).select("file", "language", "size", "is_test", "too_big")


@query
def staleness(spark, d):
    return lifecycle.stale_files(b.indexable(spark, d), b.previous_corpus(spark, d)).select("file", "content_hash")


@query
def change_class(spark, d):
    return lifecycle.classify_changes(b.corpus(spark, d), b.previous_corpus(spark, d))


@query
def snapshot_upsert(spark, d):
    now, then = b.indexable(spark, d), b.previous_corpus(spark, d)
    stale = lifecycle.stale_files(now, then)
    meta = lambda c: corpus_source.file_meta(c, F.lit(b.AS_OF_EPOCH)).drop("last_indexed")
    merged = lifecycle.upsert(meta(then), stale, meta(stale))
    return lifecycle.purge(merged, b.corpus(spark, d))


@query
def purge_deleted(spark, d):
    return lifecycle.purge(b.previous_corpus(spark, d), b.corpus(spark, d)).select("file", "content_hash")


@query
def run_stats(spark, d):
    return lifecycle.run_stats(b.scanned(spark, d), b.previous_corpus(spark, d), b.symbols(spark, d), incremental=True)


@query
def index_run(spark, d):
    """The event that a refresh of the earlier corpus logs."""
    stats = lifecycle.run_stats(b.scanned(spark, d), b.previous_corpus(spark, d), b.symbols(spark, d), incremental=True)
    return telemetry.index_run_event(stats.withColumn("elapsed", F.lit(1.5)), True, F.lit(b.AS_OF_EPOCH))


@query
def file_list(spark, d):
    return resolve.list_files(b.file_meta(spark, d))


# ---------------------------------------------------------------- extraction

@query
def line_table(spark, d):
    return prose.line_table(b.indexable(spark, d))


@query
def definitions(spark, d):
    return prose.definitions(b.indexable(spark, d))


@query
def references(spark, d):
    lines = prose.call_lines(b.indexable(spark, d)).withColumn("context", F.length("context"))
    return extract.explode_calls(lines).select("symbol_name", "caller_file", "line", "no", F.col("context").alias("context_chars"))


@query
def import_refs(spark, d):
    return prose.imports(b.indexable(spark, d))


@query
def code_definitions(spark, d):
    return extract.definitions(b.code_corpus(spark, d)).select("file", "name", "kind", "start_line", "end_line", "signature", "language")


@query
def code_calls(spark, d):
    return extract.explode_calls(extract.call_lines(b.code_corpus(spark, d))).select("symbol_name", "caller_file", "line", "context", "full_name")


@query
def code_imports(spark, d):
    return extract.imports(b.code_corpus(spark, d))


@query
def code_test_files(spark, d):
    return b.code_corpus(spark, d).select("file", "language", "is_test")


# ---------------------------------------------------------------- search

@query
def postings(spark, d):
    return search.symbol_postings(search.measured_symbols(prose.definitions(b.indexable(spark, d))))


def _one(spark, d):
    index = b.index(spark, d).only(search.token_filter(b.QUERY))
    return index, search.literal_terms(spark, b.QUERY)


@query
def symbol_search(spark, d):
    hits = search.search_symbols(*_one(spark, d))
    return hits.select("file", "name", "kind", "start_line", F.round("rank", 6).alias("rank"), "place")


@query
def call_search(spark, d):
    hits = search.search_calls(*_one(spark, d))
    return hits.select("file", "line", "no", "symbol_name", "context", F.round("rank", 6).alias("rank"), "place")


def _merged(spark, d):
    return search.search(*_one(spark, d))


_HIT = ["file", "name", "start_line", "end_line", "kind", "signature", "language", "call_context", "call_line"]


@query
def merged_search(spark, d):
    return _merged(spark, d).select(*_HIT, F.round("rank", 6).alias("rank"), "place")


def _batch(spark, d):
    return search.search(b.index(spark, d), search.query_terms(b.queries(spark, d)), whole=True)


@query
def batch_search(spark, d):
    return _batch(spark, d).select("query_id", *_HIT, F.round("rank", 6).alias("rank"), "place")


@query
def search_after_refresh(spark, d):
    """The search over an index of the earlier corpus that a refresh has brought up to date."""
    store = b.build_previous(spark, d, scratch_dir(spark, "refreshed_index"))
    b.refresh_index(store, d)
    index = store.text_index().only(search.token_filter(b.QUERY))
    return search.search(index, search.literal_terms(spark, b.QUERY)).select(*_HIT, F.round("rank", 6).alias("rank"), "place")


@query
def hits_by_file(spark, d):
    listed = search.hits_by_file(_merged(spark, d))
    return listed.select(
        "file", "first_place", "hits", F.array_join(F.transform("items", lambda x: F.concat(x["name"], F.lit(":"), x["start_line"])), ",").alias("items")
    )


# ---------------------------------------------------------------- resolve

@query
def resolve_exact(spark, d):
    return resolve.exact_matches(b.requests(spark, d), b.symbols(spark, d)).select("request_id", "name", "kind", "file", "start_line")


def _loose(spark, d, tier):
    names = b.symbols(spark, d).select("name").distinct()
    return resolve.pattern_matches(b.requests(spark, d), names).filter(F.col("tier") <= tier).select("request_id", "asked", "name")


@query
def resolve_ci(spark, d):
    return _loose(spark, d, 2)


@query
def resolve_partial(spark, d):
    return _loose(spark, d, 3)


@query
def resolve_chain(spark, d):
    return resolve.definitions(b.requests(spark, d), b.symbols(spark, d))


@query
def candidates(spark, d):
    return resolve.candidates(b.requests(spark, d), b.symbols(spark, d)).select("request_id", "name", "kind", "file", "start_line")


@query
def source_slice(spark, d):
    defs = _defs(spark, d)
    return resolve.with_source(defs, b.indexable(spark, d)).select("request_id", "name", "file", "source_code")


def _defs(spark, d):
    """Definitions of the requests, written once."""
    return stored(resolve.definitions(b.requests(spark, d), b.symbols(spark, d)), "defs")


def _sites(spark, d, defs=None):
    defs = _defs(spark, d) if defs is None else defs
    return resolve.callers(defs, b.store(spark, d).calls(resolve.asked_names(defs)))


@query
def callers(spark, d):
    sites = resolve.with_context(_sites(spark, d), b.call_lines(spark, d))
    return sites.select("request_id", "file", "line", "no", F.length("context").alias("context_chars"))


def _tested(spark, d):
    return resolve.with_enclosing_test(_sites(spark, d), b.symbols(spark, d), F.lit("python"), b.TEST_PREFIX)


@query
def enclosing_test(spark, d):
    return _tested(spark, d).filter("enclosing_test <> ''").select("request_id", "file", "line", "no", "enclosing_test")


@query
def caller_split(spark, d):
    return _tested(spark, d).groupBy("request_id").agg(
        F.count_if(F.col("enclosing_test") == "").alias("n_callers"), F.count_if(F.col("enclosing_test") != "").alias("n_tests")
    )


@query
def importers(spark, d):
    defs = _defs(spark, d)
    return resolve.importers(defs, b.store(spark, d).imports(resolve.asked_names(defs)))


@query
def last_commit(spark, d):
    return resolve.last_commits(b.commits(spark, d)).select("file", "last_commit_hash", F.date_format("last_modified", "yyyy-MM-dd").alias("last_modified"))


@query
def file_commit(spark, d):
    """The last commit of the files that requests resolve to, empty for a file that no commit names."""
    asked = resolve.found(_defs(spark, d)).select("file").distinct()
    found = resolve.commit_of(asked, resolve.last_commits(b.commits(spark, d)))
    return found.select("file", "last_commit_hash", F.date_format("last_modified", "yyyy-MM-dd").alias("last_modified"))


@query
def resolve_full(spark, d):
    git_info = resolve.last_commits(b.commits(spark, d))
    out = resolve.resolve_from(b.store(spark, d), b.requests(spark, d), b.indexable(spark, d), git_info, F.lit("python"), b.TEST_PREFIX)
    at = lambda x: F.concat(x["file"], F.lit(":"), x["line"])
    join = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    return out.select(
        "request_id", "name", "kind", "file", "start_line", "n_candidates", "source_code",
        F.coalesce("last_commit_hash", F.lit("")).alias("last_commit_hash"), "n_callers", "n_tests", "n_importers",
        join("callers", at).alias("callers"),
        join("tests", lambda x: F.concat(x["file"], F.lit(":"), x["line"], F.lit(":"), x["enclosing_test"])).alias("tests"),
        join("importers", lambda x: x).alias("importers"),
    )


# ---------------------------------------------------------------- overview

@query
def index_counts(spark, d):
    return overview.index_counts(b.file_meta(spark, d), b.symbols(spark, d))


@query
def language_counts(spark, d):
    return overview.language_counts(b.file_meta(spark, d))


@query
def top_languages(spark, d):
    return overview.top_languages(b.file_meta(spark, d))


@query
def module_summary(spark, d):
    return overview.module_summary(b.symbols(spark, d))


@query
def entry_points(spark, d):
    return overview.entry_points(b.file_meta(spark, d), b.ENTRY_NAMES)


@query
def test_summary(spark, d):
    return overview.test_summary(b.file_meta(spark, d), b.symbols(spark, d), b.TEST_PREFIX)


@query
def freshness(spark, d):
    indexed = b.events(spark, d).select(
        F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01', ts)").cast("double").alias("last_indexed")
    )
    return overview.freshness(indexed, F.lit(b.AS_OF_EPOCH + 3 * 86400))


@query
def project_overview(spark, d):
    return overview.overview(b.file_meta(spark, d), b.symbols(spark, d), b.ENTRY_NAMES, b.TEST_PREFIX)


# ---------------------------------------------------------------- telemetry

@query
def tool_summary(spark, d):
    return telemetry.tool_summary(b.events(spark, d), b.INDEX_EVENTS)


@query
def tool_timeline(spark, d):
    return telemetry.tool_timeline(b.events(spark, d), _as_of(), 7, b.INDEX_EVENTS)


@query
def index_history(spark, d):
    return telemetry.index_history(b.events(spark, d), b.INDEX_EVENTS).select(
        "id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "duration_ms", "files_indexed", "files_skipped", "symbols", "incremental"
    )


@query
def savings_total(spark, d):
    return telemetry.savings_total(b.events(spark, d), b.INDEX_EVENTS)


@query
def savings_by_tool(spark, d):
    return telemetry.savings_by_tool(b.events(spark, d), b.INDEX_EVENTS)


@query
def savings_cumulative(spark, d):
    return telemetry.savings_cumulative(b.events(spark, d), b.INDEX_EVENTS)


@query
def heatmap(spark, d):
    return telemetry.heatmap(b.events(spark, d), b.part_symbols(spark, d), b.RESOLVE_EVENT)


@query
def recall_hit_rate(spark, d):
    return telemetry.recall_hit_rate(b.events(spark, d), b.RECALL_EVENT)


@query
def response_size(spark, d):
    return telemetry.response_size(b.events(spark, d), b.INDEX_EVENTS)


@query
def response_trend(spark, d):
    return telemetry.response_trend(b.events(spark, d), _as_of(), 30, b.INDEX_EVENTS)


@query
def response_nested(spark, d):
    nested = telemetry.response_size_with_trend(b.events(spark, d), _as_of(), b.INDEX_EVENTS)
    return nested.select(
        "tool", "avg_output_tokens", F.size("trend").alias("days"),
        F.array_join(F.transform("trend", lambda x: x["date"]), ",").alias("dates"),
    )


@query
def cost_estimate(spark, d):
    return telemetry.cost_estimate(telemetry.savings_cumulative(b.events(spark, d), b.INDEX_EVENTS), "cumulative_saved")


@query
def event_metadata(spark, d):
    e = b.events(spark, d)
    k = F.col("tokens_saved").cast("bigint")
    return e.select("id", telemetry.tool_metadata(F.lit(1), k, k * 2, k, F.col("event_type"), k % 3, k % 2).alias("metadata"))


@query
def event_append(spark, d):
    """Events appended to a log in two goes and read back."""
    path = scratch_dir(spark, "event_log")
    log = b.table(spark, d, "events").select(
        F.col("event_id").alias("id"), "event_type", "ts", F.col("value").alias("duration_ms"), F.col("props").alias("metadata")
    )
    event_log.append_events(log.filter(F.col("event_type").isin(*b.INDEX_EVENTS)), path, "index")
    event_log.append_events(log.filter(~F.col("event_type").isin(*b.INDEX_EVENTS)), path, "tools")
    return event_log.read_events(spark, path).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "event_type").agg(
        F.count("*").alias("n"), F.max("id").alias("last_id")
    )


# ---------------------------------------------------------------- economy

@query
def token_estimate(spark, d):
    return economy.file_tokens(b.corpus(spark, d))


@query
def naive_search_cost(spark, d):
    return economy.naive_search_cost(_batch(spark, d), economy.file_tokens(b.corpus(spark, d)))


@query
def naive_resolve_cost(spark, d):
    defs = _defs(spark, d)
    imported = resolve.importers(defs, b.store(spark, d).imports(resolve.asked_names(defs)))
    return economy.naive_resolve_cost(defs, _sites(spark, d, defs), imported, economy.file_tokens(b.corpus(spark, d)))


@query
def naive_overview_cost(spark, d):
    return economy.naive_overview_cost(economy.file_tokens(b.corpus(spark, d)))


def _savings(spark, d):
    out = F.floor(F.col("duration_ms")).cast("bigint")
    naive = F.col("tokens_saved").cast("bigint")
    return b.events(spark, d).select(
        "session", "id", "ts", naive.alias("naive_tokens"), out.alias("output_tokens"), economy.saved(naive, out).alias("saved")
    )


@query
def saved_per_call(spark, d):
    return _savings(spark, d).drop("ts")


@query
def session_running_saved(spark, d):
    out = economy.session_running_saved(_savings(spark, d), "session", ["ts", "id"])
    return out.select("session", "id", "saved", "session_saved")


# ---------------------------------------------------------------- ledger

def _numbered(spark, d):
    return ledger.turns(b.reads(spark, d), "session", ["ts", "id"], F.to_date("ts"))


def _states(spark, d):
    return ledger.session_reads(b.reads(spark, d), "session", ["ts", "id"])


@query
def read_state(spark, d):
    return _states(spark, d).select("session", "id", "file", "turn", "state")


@query
def read_ref_turn(spark, d):
    return _states(spark, d).select("session", "id", "file", "turn", "state", F.coalesce("ref_turn", F.lit(0)).alias("ref_turn"))


def _pairs(spark, d):
    old = b.previous_corpus(spark, d).select("file", F.col("content").alias("old"))
    return b.corpus(spark, d).select("file", F.col("content").alias("new")).join(old, "file")


@query
def line_delta(spark, d):
    return ledger.line_delta(_pairs(spark, d), "file", "old", "new")


@query
def unified_delta(spark, d):
    return ledger.unified_delta(_pairs(spark, d), "file", "old", "new", F.col("file"), F.lit(1))


def _sent(spark, d):
    """Second read of every file that was read in its earlier state: notice, delta or, if new, all of it."""
    now = b.corpus(spark, d).select("file", "language", "content", "content_hash")
    before = b.previous_corpus(spark, d).select("file", F.col("content_hash").alias("seen"))
    delta = ledger.unified_delta(_pairs(spark, d), "file", "old", "new", F.col("file"), F.lit(1))
    state = (
        F.when(F.col("seen").isNull(), F.lit("full")).when(F.col("seen") == F.col("content_hash"), F.lit("unchanged")).otherwise(F.lit("changed"))
    )
    rows = now.join(before, "file", "left").join(delta, "file", "left").withColumn("state", state)
    return rows.select("file", "language", "state", ledger.sent_text(F.col("state"), F.col("file"), F.lit(1), F.col("content"), F.col("delta")).alias("sent"))


@query
def sent_tokens(spark, d):
    return _sent(spark, d).select("file", "state", text.token_estimate(F.col("sent")).alias("output_tokens"))


# ---------------------------------------------------------------- recall and session logs

@query
def similarity_rank(spark, d):
    return recall.ranking(b.centroids(spark, d), b.vectors(spark, d))


@query
def best_match(spark, d):
    return recall.best_match(b.centroids(spark, d), b.vectors(spark, d))


@query
def text_recall(spark, d):
    """Best earlier conversation for each benchmark text, with the default encoder."""
    memory = b.table(spark, d, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    asked = b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return recall.best_match(
        recall.hashed_embedding(asked, "text", "vec"), recall.hashed_embedding(memory, "text", "vec"), 0.05
    )


def _records(spark, d):
    return session_logs.parse_records(b.raw_log(spark, d))


@query
def log_lines(spark, d):
    """Conversations written as eight logs and read back line by line."""
    path = scratch_dir(spark, "logs")
    said = b.table(spark, d, "conversations").select((F.col("conv_id") % 8).alias("log"), "conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role")).alias("value"))
    said.repartition("log").sortWithinPartitions("log", "conv_id", "turn").select("log", "value").write.partitionBy("log").text(path)
    lines = session_logs.read_logs(spark, f"{path}/*")
    return lines.select(F.regexp_extract("project", "log=(.*)", 1).cast("bigint").alias("log"), "pos", "raw")


@query
def session_digest(spark, d):
    return transcripts.session_digest(_records(spark, d)).select(
        "session", "task_text", F.array_join("files_read", ",").alias("files_read"), F.array_join("symbols_resolved", ",").alias("symbols_resolved"), "session_id"
    )


@query
def session_list(spark, d):
    digests = recall.hashed_embedding(transcripts.session_digest(_records(spark, d)), "task_text")
    path = scratch_dir(spark, "session_memory")
    memory_store.insert(memory_store.as_memory(digests, F.col("session"), "embedding", F.timestamp_seconds(F.col("session"))), path)
    return recall.session_list(memory_store.load(spark, path)).select(
        "id", "session_id", F.length("task_text").alias("task_chars"), "n_files", "n_symbols", "outcome", "confidence"
    )


@query
def newest_sessions(spark, d):
    logs = b.events(spark, d).groupBy(F.col("event_type").alias("project"), "session").agg(F.max("ts").alias("mtime"))
    return session_logs.list_sessions(logs).select("project", "session", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


@query
def latest_session(spark, d):
    logs = b.events(spark, d).select(F.col("event_type").alias("project"), "session", F.col("ts").alias("mtime"))
    return session_logs.latest_per_project(logs).select("project", "session", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"))


@query
def turn_pairs(spark, d):
    return transcripts.turns(_records(spark, d)).select("session", "pos", "user", F.array_join("tools", ",").alias("tools"))


@query
def turn_tokens(spark, d):
    return transcripts.turns(_records(spark, d)).select("session", "pos", "new_tokens", "cache_read", "total_ctx", "out_tokens")


@query
def session_totals(spark, d):
    return transcripts.session_totals(transcripts.turns(_records(spark, d)))


@query
def turn_classes(spark, d):
    out = transcripts.turn_classes(transcripts.turns(_records(spark, d)))
    return out.select("turn_class", "turns", F.round("avg_new_tokens", 4).alias("avg_new_tokens"))


# ---------------------------------------------------------------- redaction

@query
def redact_literals(spark, d):
    return b.corpus(spark, d).select("file", redact.redact_code(F.col("content"), "python", POLICY).alias("content"))


@query
def redact_kv(spark, d):
    return b.corpus(spark, d).select("file", redact.redact_env(F.col("content"), POLICY).alias("content"))


@query
def redact_dispatch(spark, d):
    """French documents as .env files, English ones as code, others without an adapter."""
    name = F.when(F.col("language") == "fr", F.concat("file", F.lit(".env"))).otherwise(F.col("file"))
    lang = F.when(F.col("language") == "en", F.lit("python"))
    return b.corpus(spark, d).select("file", redact.redact(F.col("content"), name, lang, POLICY).alias("content"))


@query
def redact_languages(spark, d):
    """Literals of Python, JavaScript, Go and Rust files."""
    code = b.literal_code(spark, d)
    return code.select("file", redact.redact(F.col("content"), F.col("file"), F.col("language"), POLICY).alias("content"))


# A changed policy: one more type than the default ones, one less, and values that are always shown.
CHANGED_POLICY = redact.Policy(enabled=True).watch("private_url").ignore("account_number").allow(r"[aeiou]{2}")


@query
def redact_policy(spark, d):
    code = b.literal_code(spark, d)
    return code.select("file", redact.redact(F.col("content"), F.col("file"), F.col("language"), CHANGED_POLICY).alias("content"))


@query
def redact_sent(spark, d):
    """What a second read of every file sends, redacted: whole files, deltas and notices alike. French documents count as
    .env files, English ones as code."""
    name = F.when(F.col("language") == "fr", F.concat("file", F.lit(".env"))).otherwise(F.col("file"))
    lang = F.when(F.col("language") == "en", F.lit("python"))
    return _sent(spark, d).select("file", redact.redact(F.col("sent"), name, lang, POLICY).alias("sent"))


@query
def entity_counts(spark, d):
    return redact.entity_counts(prose.line_table(b.corpus(spark, d), "language"), "text", ["language"], POLICY)


# ---------------------------------------------------------------- ad-hoc SQL

@query
def adhoc_sql(spark, d):
    catalog.register({"lore_symbols": b.symbols(spark, d), "lore_imports": b.imports(spark, d)})
    return catalog.query(
        spark,
        "SELECT s.language, count(*) AS n, count(DISTINCT s.name) AS names FROM lore_symbols s "
        "WHERE s.kind = :kind AND s.name IN (SELECT symbol_name FROM lore_imports) GROUP BY s.language",
        {"kind": "class"},
    )


# ---------------------------------------------------------------- streams

@query
def stream_timeline(spark, d):
    source = spark.readStream.schema(b.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    utc = F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts))")
    log = source.select("event_type", utc.alias("ts"), F.get_json_object("props", "$.k").try_cast("double").alias("tokens_saved"))
    work = scratch_dir(spark, "stream_timeline")
    flows.drain(flows.timeline(log, index_events=b.INDEX_EVENTS), flows.parquet_sink(f"{work}/out"), f"{work}/ckpt", "update")
    return flows.latest(spark, f"{work}/out", "date string, tool string, call_count bigint, tokens_saved bigint", ["date", "tool"])


@query
def stream_reads(spark, d):
    work = scratch_dir(spark, "stream_reads")
    _numbered(spark, d).select("session", "file", "turn", "hash").write.parquet(f"{work}/in")
    source = spark.readStream.schema("session bigint, file string, turn bigint, hash string").parquet(f"{work}/in")
    flows.drain(flows.read_states(source), flows.parquet_sink(f"{work}/out"), f"{work}/ckpt")
    return spark.read.schema("session bigint, file string, turn bigint, state string, ref_turn bigint").parquet(f"{work}/out").select(
        "session", "file", "turn", "state", F.coalesce("ref_turn", F.lit(0)).alias("ref_turn")
    )


@query
def stream_index(spark, d):
    """An index of the earlier corpus, refreshed by a feed of the present one; gone files come as empty rows."""
    work = scratch_dir(spark, "stream_index")
    store, then = b.build_previous(spark, d, f"{work}/index"), b.previous_corpus(spark, d)
    feed = b.indexable(spark, d).select("file", "language", "content").unionByName(
        then.join(b.corpus(spark, d), "file", "left_anti").select("file", "language", F.lit(None).cast("string").alias("content"))
    )
    feed.write.parquet(f"{work}/in")
    source = spark.readStream.schema("file string, language string, content string").parquet(f"{work}/in")
    flows.drain(source, flows.index_feed(store, 2, b.EXTRACTORS, lambda c: corpus_source.file_meta(c, F.lit(b.AS_OF_EPOCH))), f"{work}/ckpt")
    per_file = store.relation("symbols").groupBy("file").agg(F.count("*").alias("symbols"))
    return store.file_meta().join(per_file, "file", "left").select(
        "file", "content_hash", "line_count", F.coalesce("symbols", F.lit(0)).alias("symbols")
    )


@query
def stream_savings(spark, d):
    source = spark.readStream.schema(b.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    calls = source.select(F.col("user_id").alias("session"), economy.saved(k, F.floor("value").cast("bigint")).alias("saved"))
    work = scratch_dir(spark, "stream_savings")
    flows.drain(flows.running_savings(calls), flows.parquet_sink(f"{work}/out"), f"{work}/ckpt", "update")
    return flows.latest(spark, f"{work}/out", "session bigint, session_saved bigint, calls bigint", ["session"])
