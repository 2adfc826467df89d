"""Usage telemetry: one event log, the aggregates a dashboard draws from it.

Every function takes the parsed log (``parse_events``) and returns a DataFrame. The JSON column is
parsed once; each aggregate combines on the map side, so the shuffle carries one row per group and
task whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Event types of index runs, event type of recall, price in dollars per token.
INDEX_EVENTS = ("init", "update")
DOLLARS_PER_TOKEN = 5 / 1_000_000
QUERY_CHARS = 200

NUMBER_KEYS = ("result_count", "output_tokens", "naive_tokens", "tokens_saved", "files_indexed", "files_skipped", "symbols")
TEXT_KEYS = ("query", "incremental")


def parse_events(log: DataFrame, ts: str = "timestamp", metadata: str = "metadata", keys: dict[str, str] | None = None) -> DataFrame:
    """Types the event log. ``keys`` maps a field to another JSON key; epoch seconds become UTC time.

    JSON scalars are read as text and cast with ``try_cast``: a bad value gives null, not an error.
    """
    keys = {k: k for k in (*NUMBER_KEYS, *TEXT_KEYS)} if keys is None else keys
    names = sorted(set(keys.values()))
    parsed = log.withColumn("_m", F.from_json(metadata, ", ".join(f"`{n}` string" for n in names)))
    when = F.col(ts)
    if dict(log.dtypes)[ts] == "double":
        when = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({ts} as decimal(18,6)))")
    fields = []
    for field, key in keys.items():
        raw = F.col("_m").getField(key)
        fields.append((raw if field in TEXT_KEYS else raw.try_cast("double")).alias(field))
    carried = [c for c in log.columns if c not in (ts, metadata, *keys)]
    return parsed.select(*carried, when.alias("ts"), *fields)


def _whole(col: str) -> Column:
    """CAST AS INTEGER of a JSON number: the fraction is cut off."""
    return F.col(col).cast("bigint")


def _saved() -> Column:
    return F.coalesce(F.sum(_whole("tokens_saved")), F.lit(0)).cast("bigint")


def _day() -> Column:
    return F.date_format(F.to_date("ts"), "yyyy-MM-dd")


def _tools(events: DataFrame, index_events) -> DataFrame:
    return events.filter(~F.col("event_type").isin(*index_events))


def _since(as_of: Column, days: int) -> Column:
    return F.col("ts") >= as_of - F.make_dt_interval(F.lit(days))


def tool_summary(events: DataFrame, index_events=INDEX_EVENTS) -> DataFrame:
    return (
        _tools(events, index_events)
        .groupBy(F.col("event_type").alias("tool"))
        .agg(F.count("*").alias("call_count"), _saved().alias("total_tokens_saved"))
        .orderBy(F.desc("call_count"), "tool")
    )


def tool_timeline(events: DataFrame, as_of: Column, days: int = 30, index_events=INDEX_EVENTS) -> DataFrame:
    """Calls and savings per UTC day over the last ``days`` days before the instant ``as_of``."""
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    return (
        _tools(events, index_events)
        .filter(_since(as_of, days))
        .groupBy(_day().alias("date"))
        .agg(F.count("*").alias("call_count"), _saved().alias("tokens_saved"))
        .orderBy("date")
    )


def index_history(events: DataFrame, index_events=INDEX_EVENTS) -> DataFrame:
    return (
        events.filter(F.col("event_type").isin(*index_events))
        .select(
            "id",
            "event_type",
            "ts",
            "duration_ms",
            _whole("files_indexed").alias("files_indexed"),
            _whole("files_skipped").alias("files_skipped"),
            _whole("symbols").alias("symbols"),
            "incremental",
        )
        .orderBy(F.desc("ts"), F.desc("id"))
    )


def savings_total(events: DataFrame, index_events=INDEX_EVENTS) -> DataFrame:
    return _tools(events, index_events).agg(_saved().alias("total_tokens_saved"))


def savings_by_tool(events: DataFrame, index_events=INDEX_EVENTS) -> DataFrame:
    return (
        _tools(events, index_events)
        .groupBy(F.col("event_type").alias("tool"))
        .agg(_saved().alias("tokens_saved"))
        .orderBy(F.desc("tokens_saved"), "tool")
    )


def savings_cumulative(events: DataFrame, index_events=INDEX_EVENTS) -> DataFrame:
    """Running savings by day. Days are aggregated first: the single-partition window sees one row per day."""
    daily = _tools(events, index_events).groupBy(_day().alias("date")).agg(_saved().alias("daily_saved"))
    upto = W.orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.select("date", F.sum("daily_saved").over(upto).alias("cumulative_saved")).orderBy("date")


def heatmap(events: DataFrame, symbols: DataFrame, resolve_event: str, limit: int = 20) -> DataFrame:
    """Most resolved names with the file and kind of their first definition.

    ``call_count`` counts an event once per definition of its name, ``event_count`` once. Both sides
    are aggregated to one row per name before they meet, so a name that holds most of the log costs
    one row in the join.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    asked = (
        events.filter((F.col("event_type") == resolve_event) & F.col("query").isNotNull())
        .groupBy(F.col("query").alias("symbol"))
        .agg(F.count("*").alias("event_count"))
    )
    defs = symbols.groupBy(F.col("name").alias("symbol")).agg(
        F.count("*").alias("defs"), F.min(F.struct("file", "start_line", "kind")).alias("first")
    )
    return (
        asked.join(defs, "symbol", "left")
        .select(
            "symbol",
            (F.col("event_count") * F.coalesce("defs", F.lit(1))).alias("call_count"),
            "event_count",
            F.col("first.file").alias("file"),
            F.col("first.kind").alias("kind"),
        )
        .orderBy(F.desc("call_count"), "symbol")
        .limit(limit)
    )


def recall_hit_rate(events: DataFrame, recall_event: str) -> DataFrame:
    counted = events.filter(F.col("event_type") == recall_event).agg(
        F.count("*").alias("total_calls"), F.count_if(_whole("tokens_saved") > 0).alias("hits")
    )
    total = F.col("total_calls")
    return counted.select(
        "total_calls",
        "hits",
        (total - F.col("hits")).alias("misses"),
        F.when(total > 0, F.round(F.col("hits") / total * 100, 1)).otherwise(F.lit(0.0)).alias("hit_rate_pct"),
    )


def response_size(events: DataFrame, index_events=INDEX_EVENTS) -> DataFrame:
    return (
        _tools(events, index_events)
        .filter(F.col("output_tokens").isNotNull())
        .groupBy(F.col("event_type").alias("tool"))
        .agg(F.round(F.avg("output_tokens"), 1).alias("avg_output_tokens"))
        .orderBy(F.desc("avg_output_tokens"), "tool")
    )


def response_trend(events: DataFrame, as_of: Column, days: int = 30, index_events=INDEX_EVENTS) -> DataFrame:
    return (
        _tools(events, index_events)
        .filter(F.col("output_tokens").isNotNull() & _since(as_of, days))
        .groupBy(F.col("event_type").alias("tool"), _day().alias("date"))
        .agg(F.round(F.avg("output_tokens"), 1).alias("avg"))
        .orderBy("tool", "date")
    )


def response_size_with_trend(events: DataFrame, as_of: Column, index_events=INDEX_EVENTS) -> DataFrame:
    """One row per tool with its 30 daily means as a nested list."""
    trend = (
        response_trend(events, as_of, 30, index_events)
        .groupBy("tool")
        .agg(F.sort_array(F.collect_list(F.struct("date", "avg"))).alias("trend"))
    )
    return response_size(events, index_events).join(trend, "tool", "left").orderBy(F.desc("avg_output_tokens"), "tool")


def cost_estimate(savings: DataFrame, tokens: str) -> DataFrame:
    """Adds dollars (2 and 4 decimals) and thousands of tokens to any table of token counts."""
    dollars = F.col(tokens) * F.lit(DOLLARS_PER_TOKEN)
    return savings.select(
        "*",
        F.round(dollars, 4).alias("dollars"),
        F.round(F.col(tokens) / 1000, 0).cast("bigint").alias("tokens_k"),
        F.round(F.col(tokens) / 1000, 1).alias("tokens_k1"),
    )


def tool_metadata(result_count: Column, output_tokens: Column, naive_tokens: Column, tokens_saved: Column,
                  query: Column | None = None, matched_files: Column | None = None, grep_overhead: Column | None = None) -> Column:
    """JSON metadata of a tool call. The optional keys appear only when they are not empty or zero."""
    fields = [
        result_count.alias("result_count"),
        output_tokens.alias("output_tokens"),
        naive_tokens.alias("naive_tokens"),
        tokens_saved.alias("tokens_saved"),
    ]
    if query is not None:
        fields.append(F.when(query != "", F.substring(query, 1, QUERY_CHARS)).alias("query"))
    if matched_files is not None:
        fields.append(F.when(matched_files != 0, matched_files).alias("matched_files"))
    if grep_overhead is not None:
        fields.append(F.when(grep_overhead != 0, grep_overhead).alias("grep_overhead"))
    return F.to_json(F.struct(*fields))


def index_run_event(stats: DataFrame, incremental: bool, as_of: Column) -> DataFrame:
    """Event row of an index run from its statistics (``elapsed`` in seconds)."""
    return stats.select(
        F.lit("update" if incremental else "init").alias("event_type"),
        as_of.alias("ts"),
        (F.col("elapsed") * 1000).alias("duration_ms"),
        F.to_json(
            F.struct("files_indexed", "files_skipped", "symbols", F.lit(incremental).alias("incremental"))
        ).alias("metadata"),
    )
