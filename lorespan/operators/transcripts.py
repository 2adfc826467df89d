"""Session logs as tables: digest of a session, turns with their token use, totals and classes.

Input are parsed records (session, pos, rec); ``pos`` orders a session. Ordered steps run per block
of positions (``functions.carry``), so one very long session is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.functions import carry, text
from lorespan.sources.session_logs import blocks, is_text, text_field, truthy

# Tool names of the file reader, and default names of the indexed tools.
READ_TOOL = "Read"
INDEXED_TOOLS = ("index_search", "index_resolve", "index_overview", "index_read")
INDEXED_READ, INDEXED_RESOLVE = "index_read", "index_resolve"
NATIVE_TOOLS = ("Read", "Grep", "Glob", "Bash", "Write", "Edit")
USER_CHARS = 120
NO_USER = "(no user message)"
BLOCK_RECORDS = 10_000

USAGE = ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")


def _block(pos: str) -> Column:
    return F.floor(F.col(pos) / BLOCK_RECORDS)


def _typed_blocks(kind: str) -> Column:
    listed = F.coalesce(blocks(F.col("rec")), F.array().cast("array<variant>"))
    return F.filter(listed, lambda b: text_field(b, "$.type") == kind)


def _texts() -> Column:
    return F.transform(_typed_blocks("text"), lambda b: F.coalesce(text_field(b, "$.text"), F.lit("")))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def session_digest(records: DataFrame, read_tool: str = READ_TOOL, indexed_read: str = INDEXED_READ, resolve_tool: str = INDEXED_RESOLVE) -> DataFrame:
    """One row per session: task (first human message), files read, names resolved, first session id.

    Names are reduced to their first position before they are listed, so a list is as long as the
    number of different names and not of calls.
    """
    rec = F.col("rec")
    kind = text_field(rec, "$.type")
    plain = is_text(rec, "$.message.content")
    first_text = F.when(plain, text_field(rec, "$.message.content")).otherwise(F.get(_texts(), 0))
    task = F.when((kind == "user") & ~truthy(rec, "$.toolUseResult"), F.nullif(_strip(first_text), F.lit("")))
    sid = F.nullif(text_field(rec, "$.sessionId"), F.lit(""))
    heads = records.select("session", "pos", task.alias("task"), sid.alias("sid")).groupBy("session").agg(
        F.min_by("task", F.when(F.col("task").isNotNull(), F.col("pos"))).alias("task_text"),
        F.min_by("sid", F.when(F.col("sid").isNotNull(), F.col("pos"))).alias("session_id"),
    )
    uses = text.unfold(records.filter(kind == "assistant"), ["session", "pos"], _typed_blocks("tool_use"), "i", "b")
    tool = text_field(F.col("b"), "$.name")
    touched = (
        uses.select(
            "session",
            F.struct("pos", "i").alias("at"),
            F.when(tool == resolve_tool, F.lit("symbol")).otherwise(F.lit("file")).alias("what"),
            F.when(tool == read_tool, text_field(F.col("b"), "$.input.file_path"))
            .when(tool == indexed_read, text_field(F.col("b"), "$.input.file"))
            .when(tool == resolve_tool, text_field(F.col("b"), "$.input.symbol"))
            .alias("name"),
        )
        .filter(F.col("name") != "")
        .groupBy("session", "what", "name")
        .agg(F.min("at").alias("at"))
    )
    listed = lambda what: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("what") == what, F.struct("at", "name")))), lambda x: x["name"]
    )
    names = touched.groupBy("session").agg(listed("file").alias("files_read"), listed("symbol").alias("symbols_resolved"))
    none = F.array().cast("array<string>")
    return heads.join(names, "session", "left").select(
        "session",
        F.coalesce("task_text", F.lit("")).alias("task_text"),
        F.coalesce("files_read", none).alias("files_read"),
        F.coalesce("symbols_resolved", none).alias("symbols_resolved"),
        "session_id",
    )


def turns(records: DataFrame) -> DataFrame:
    """Assistant records with usage, each with the latest user message since the one before it.

    A user message marks the session with its text, an assistant record with usage clears the mark;
    the turn shows the last mark before it. Records without usage leave the mark in place.
    """
    rec = F.col("rec")
    kind = text_field(rec, "$.type")
    has_usage = (kind == "assistant") & truthy(rec, "$.message.usage")
    results = F.size(_typed_blocks("tool_result"))
    shown = lambda c: F.replace(F.substring(c, 1, USER_CHARS), F.lit("\n"), F.lit(" "))
    said = (
        F.when(is_text(rec, "$.message.content"), shown(text_field(rec, "$.message.content")))
        .when(F.size(_texts()) > 0, shown(F.array_join(_texts(), " ")))
        .when(results > 0, F.format_string("[tool result ×%d]", results))
    )
    usage = [F.coalesce(F.try_variant_get(rec, f"$.message.usage.{u}", "bigint"), F.lit(0)).alias(u) for u in USAGE]
    tools = F.transform(_typed_blocks("tool_use"), lambda b: F.coalesce(text_field(b, "$.name"), text_field(b, "$.type")))
    flat = records.filter(kind.isin("user", "assistant")).select(
        "session", "pos", (kind == "user").alias("is_user"), F.coalesce(has_usage, F.lit(False)).alias("has_usage"),
        F.when(kind == "user", said).alias("said"), tools.alias("tools"), *usage,
    )
    mark = F.when(F.col("has_usage") | (F.col("is_user") & F.col("said").isNotNull()), F.struct(F.when(F.col("is_user"), F.col("said")).alias("t")))
    paired = carry.last_before(flat, ["session"], ["pos"], _block("pos"), {"_mark": mark}).filter("has_usage")
    new = F.col("input_tokens") + F.col("cache_creation_input_tokens")
    return paired.select(
        "session",
        "pos",
        F.coalesce(F.nullif(F.col("_mark.t"), F.lit("")), F.lit(NO_USER)).alias("user"),
        "tools",
        new.alias("new_tokens"),
        F.col("cache_read_input_tokens").alias("cache_read"),
        (new + F.col("cache_read_input_tokens")).alias("total_ctx"),
        F.col("output_tokens").alias("out_tokens"),
    )


def session_totals(turn_rows: DataFrame) -> DataFrame:
    return turn_rows.groupBy("session").agg(
        F.count("*").alias("turns"),
        *[F.sum(c).alias(c) for c in ("new_tokens", "cache_read", "total_ctx", "out_tokens")],
    )


def turn_classes(turn_rows: DataFrame, indexed=INDEXED_TOOLS, native=NATIVE_TOOLS) -> DataFrame:
    """Turns that used an indexed tool, and those that used only native ones, with mean new tokens."""
    hit = lambda names: F.arrays_overlap("tools", F.array(*[F.lit(n) for n in names]))
    cls = F.when(hit(indexed), F.lit("indexed")).when(hit(native), F.lit("native"))
    return (
        turn_rows.withColumn("turn_class", cls)
        .filter(F.col("turn_class").isNotNull())
        .groupBy("turn_class")
        .agg(F.count("*").alias("turns"), F.avg("new_tokens").alias("avg_new_tokens"))
    )
