"""Everything about a name: definition, candidates, callers, enclosing tests, importers, last commit.

Requests are a table (request_id, name). Names meet definitions in equi-joins only; the pattern tiers
look patterns up by the rarest of the short literal pieces (grams) that a matching name must contain.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import paths, text
from lorespan.operators import extract
from lorespan.session import stored

if TYPE_CHECKING:
    from lorespan.sources.index_store import IndexStore

GRAM = 3
#: Parts that names of one length are dealt to.
SPREAD = 16
#: Spans meet calls in blocks of two to this power lines.
LINE_BIN = 6
# How many entries the text view of a result lists.
SHOWN_CALLERS, SHOWN_TESTS, SHOWN_IMPORTERS = 10, 5, 8


def exact_matches(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    return requests.withColumnRenamed("name", "asked").join(symbols, F.col("asked") == F.col("name"))


def _grams(string: Column, size: Column) -> Column:
    """All pieces of a string of a size, each once."""
    starts = F.when(F.length(string) < size, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(string) - size + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(string, i, size)))


def pattern_matches(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request_id, asked, name, tier): 2 when the whole name matches the request as a pattern, 3 when a part does.

    ``%`` and ``_`` in a request are wildcards. ``names`` holds each name once. A matching name holds all pieces of the
    request that have no wildcard; names and requests meet on the request's rarest piece of up to ``GRAM`` letters, by
    the number of names that hold it. A request of wildcards alone asks for the length of a name only.
    """
    runs = F.split(text.ascii_lower(F.col("name")), "[%_]")
    size = F.least(F.lit(GRAM), F.array_max(F.transform(runs, lambda r: F.length(r))))
    asked = requests.filter(F.col("name").isNotNull()).select("request_id", F.col("name").alias("asked"), runs.alias("runs"), size.alias("size"))
    literal = asked.filter("size > 0").select("request_id", "asked", F.explode(F.array_distinct(F.flatten(F.transform("runs", lambda r: _grams(r, F.col("size")))))).alias("gram"))
    sizes = asked.filter("size > 0").agg(F.collect_set("size")).scalar()
    grams = names.select("name", F.explode(sizes).alias("g")).select("name", F.explode(_grams(text.ascii_lower(F.col("name")), F.col("g"))).alias("gram"))
    counts = grams.join(literal.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = literal.join(counts, "gram", "left").groupBy("request_id", "asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    by_gram = grams.join(rarest.filter("m.n > 0").select("request_id", "asked", F.col("m.gram").alias("gram")), "gram").drop("gram")

    # a name of exactly the wildcards' length matches as a whole where no % is, any longer one in part
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(SPREAD)).cast("int")
    any_name = asked.filter("size = 0").select("request_id", "asked", F.length(F.replace("asked", F.lit("%"), F.lit(""))).alias("least"))
    lengths = names.agg(F.collect_set(F.length("name"))).scalar()
    every = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    wanted = any_name.select("*", F.explode(lengths).alias("length")).filter("length >= least").select("request_id", "asked", "length", every.alias("spread"))
    by_length = names.select("name", F.length("name").alias("length"), spread("name").alias("spread")).join(wanted, ["length", "spread"])

    whole = text.like_ascii_ci(F.col("name"), F.col("asked"))
    part = text.like_ascii_ci(F.col("name"), F.concat(F.lit("%"), F.col("asked"), F.lit("%")))
    found = by_gram.select("request_id", "asked", "name").unionByName(by_length.select("request_id", "asked", "name"))
    return found.filter(part).select("request_id", "asked", "name", F.when(whole, F.lit(2)).otherwise(F.lit(3)).alias("tier")).distinct()


def matched_names(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names of the first tier with any match: 1 exact, 2 any case, 3 part of the name.

    Pattern tiers see only requests without an exact match, and distinct names instead of rows.
    """
    names = symbols.select("name").distinct()
    exact = requests.join(names, "name", "left_semi").select(
        "request_id", F.col("name").alias("asked"), "name", F.lit(1).alias("tier")
    )
    rest = requests.join(names, "name", "left_anti")
    loose = pattern_matches(rest, names)
    first = loose.groupBy("request_id").agg(F.min("tier").alias("tier"))
    return exact.unionByName(loose.join(first, ["request_id", "tier"]).select("request_id", "asked", "name", "tier"))


def candidates(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """All definitions of the tier that answers a request. Names found are written down: plans know how few they are, so
    definitions are not shuffled to meet them."""
    return stored(matched_names(requests, symbols), "matched_names").join(symbols, "name")


def definitions(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per request: first definition by file and line, number of candidates; kind unknown when none.

    The first is found without texts, which are then read for the definitions found only.
    """
    place = ["file", "start_line", "no", "name", "kind", "end_line"]
    short = candidates(requests, symbols.select(*place)).groupBy("request_id").agg(F.min(F.struct(*place, "tier")).alias("d"), F.count("*").alias("n"))
    placed = stored(short.select("request_id", "n", "d.tier", *[F.col(f"d.{c}").alias(f"_{c}") for c in place]), "first_places")
    same = F.lit(True)
    for c in place:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    first = symbols.join(placed, same).groupBy("request_id").agg(
        F.min(F.struct(*place, "signature", "language", "tier")).alias("d"), F.first("n").alias("n")
    )
    return requests.join(first, "request_id", "left").select(
        "request_id",
        F.col("name").alias("asked"),
        F.coalesce("d.name", "name").alias("name"),
        F.coalesce("d.kind", F.lit("unknown")).alias("kind"),
        F.coalesce("d.file", F.lit("")).alias("file"),
        F.coalesce("d.start_line", F.lit(0)).alias("start_line"),
        F.coalesce("d.end_line", F.lit(0)).alias("end_line"),
        F.coalesce("d.signature", F.lit("")).alias("signature"),
        F.coalesce("d.language", F.lit("")).alias("language"),
        F.coalesce("d.tier", F.lit(0)).alias("tier"),
        F.coalesce("n", F.lit(0)).alias("n_candidates"),
    )


def found(defs: DataFrame) -> DataFrame:
    return defs.filter(F.col("kind") != "unknown")


def with_source(defs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds the text of the definition, empty when the file is not there."""
    sliced = extract.source_slice(F.col("content"), F.greatest("start_line", F.lit(1)), F.col("end_line"))
    return defs.join(corpus.select("file", "content"), "file", "left").select(
        *defs.columns, F.when(F.col("content").isNull() | (F.col("end_line") < 1), F.lit("")).otherwise(sliced).alias("source_code")
    )


def asked_names(defs: DataFrame) -> DataFrame:
    """``(symbol_name)`` of the definitions found, each once."""
    return found(defs).select(F.col("name").alias("symbol_name")).distinct()


def callers(defs: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites (request_id, file, line, no) of each request's definition.

    ``calls`` are rows per call (symbol_name, file, line, no), such as an index keeps by name, or call lines, which are
    unfolded without their text; ``with_context`` adds it to the sites that are shown. A name that most calls use stays on
    the calls' side of a broadcast join while requests are few; AQE splits it when they are not.
    """
    asked = found(defs).select("request_id", F.col("name").alias("symbol_name"))
    if "refs" in calls.columns:
        calls = text.unfold(calls, ["file", "line"], F.transform("refs", lambda r: r["name"]), "no", "symbol_name")
    return calls.join(asked, "symbol_name").select("request_id", "file", "line", "no")


def with_context(sites: DataFrame, call_lines: DataFrame) -> DataFrame:
    return sites.join(call_lines.select("file", "line", "context"), ["file", "line"])


def with_enclosing_test(sites: DataFrame, symbols: DataFrame, language: Column, prefix: str = "test") -> DataFrame:
    """Adds the innermost definition named test... around each call in a test file, else ''.

    Only test files and such definitions take part. A span stands once for each block of ``LINE_BIN`` lines that it
    touches, and meets the calls of that file and block.
    """
    bins = F.sequence(F.shiftright("start_line", LINE_BIN), F.shiftright(F.greatest("start_line", "end_line"), LINE_BIN))
    spans = symbols.filter(F.startswith(text.ascii_lower(F.col("name")), F.lit(prefix))).select(
        "file", F.col("name").alias("_test"), "start_line", "end_line", F.explode(bins).alias("_bin")
    )
    site = ["request_id", "file", "line", "no"]
    inside = (
        sites.filter(paths.is_test_file(F.col("file"), language))
        .select(*site, F.shiftright("line", LINE_BIN).alias("_bin"))
        .join(spans, ["file", "_bin"])
        .filter((F.col("start_line") <= F.col("line")) & (F.col("end_line") >= F.col("line")))
        .groupBy(*site)
        .agg(F.max_by("_test", F.struct("start_line", "_test")).alias("enclosing_test"))
    )
    return sites.join(inside, site, "left").withColumn("enclosing_test", F.coalesce("enclosing_test", F.lit("")))


def importers(defs: DataFrame, imports: DataFrame) -> DataFrame:
    asked = found(defs).select("request_id", F.col("name").alias("symbol_name"))
    return imports.select("symbol_name", "file").join(asked, "symbol_name").select("request_id", "file").distinct()


def last_commits(commits: DataFrame) -> DataFrame:
    """Latest commit per file of a commit log (file, commit, author_ts)."""
    return commits.groupBy("file").agg(F.max(F.struct("author_ts", "commit")).alias("c")).select(
        "file", F.col("c.commit").alias("last_commit_hash"), F.col("c.author_ts").alias("last_modified")
    )


def commit_of(files: DataFrame, git_info: DataFrame) -> DataFrame:
    """Last commit of each asked file (file), with an empty hash where none is known."""
    return files.select("file").join(git_info, "file", "left").withColumn("last_commit_hash", F.coalesce("last_commit_hash", F.lit("")))


def _top(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows per request, numbered ``_p``."""
    return rows.withColumn("_p", F.row_number().over(W.partitionBy("request_id").orderBy(*order))).filter(F.col("_p") <= n)


def _in_order(value: Column) -> Column:
    """The non-null values of a group by ``_p``; null if there are none."""
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("_p", value.alias("v")))))
    return F.when(F.size(pairs) > 0, F.transform(pairs, lambda x: x["v"]))


def resolve(requests: DataFrame, symbols: DataFrame, call_lines: DataFrame, imports: DataFrame, corpus: DataFrame,
            git_info: DataFrame, language: Column | None = None, test_prefix: str = "test",
            shown_callers: int = SHOWN_CALLERS, shown_tests: int = SHOWN_TESTS, shown_importers: int = SHOWN_IMPORTERS) -> DataFrame:
    """One row per request for display: the lists hold the first entries, as many as asked for, the counts all.

    The whole lists are the relations ``callers``, ``importers`` and ``candidates``, a row per entry: a name used
    by a third of all calls must not become one row. Definitions and sites are written once and read by each part.
    """
    defs = stored(definitions(requests, symbols), "resolve_defs")
    shown = (shown_callers, shown_tests, shown_importers)
    return _assembled(defs, symbols, call_lines, call_lines, imports, corpus, git_info, language, test_prefix, shown)


def resolve_from(store: IndexStore, requests: DataFrame, corpus: DataFrame, git_info: DataFrame, language: Column | None = None, test_prefix: str = "test",
                 shown_callers: int = SHOWN_CALLERS, shown_tests: int = SHOWN_TESTS, shown_importers: int = SHOWN_IMPORTERS) -> DataFrame:
    """``resolve`` over a stored index: calls and imports are read from the folders of the names found only."""
    symbols = store.relation("symbols")
    defs = stored(definitions(requests, symbols), "resolve_defs")
    names, shown = asked_names(defs), (shown_callers, shown_tests, shown_importers)
    return _assembled(defs, symbols, store.calls(names), store.relation("call_lines"), store.imports(names), corpus, git_info, language, test_prefix, shown)


def _assembled(defs: DataFrame, symbols: DataFrame, calls: DataFrame, call_lines: DataFrame, imports: DataFrame, corpus: DataFrame, git_info: DataFrame,
               language: Column | None, test_prefix: str, shown: tuple[int, int, int]) -> DataFrame:
    shown_callers, shown_tests, shown_importers = shown
    lang = paths.language_of(F.col("file")) if language is None else language
    sites = stored(with_enclosing_test(callers(defs, calls), symbols, lang, test_prefix), "resolve_sites")
    is_test = F.col("enclosing_test") != ""
    order = ["file", "line", "no"]
    imported_from = importers(defs, imports)
    counts = sites.groupBy("request_id").agg(F.count_if(~is_test).alias("n_callers"), F.count_if(is_test).alias("n_tests"))
    n_imports = imported_from.groupBy("request_id").agg(F.count("*").alias("n_importers"))
    top = F.row_number().over(W.partitionBy("request_id", is_test).orderBy(*order))
    most = F.when(is_test, shown_tests).otherwise(shown_callers)
    first = with_context(sites.withColumn("_p", top).filter(F.col("_p") <= most), call_lines)
    sites_listed = first.groupBy("request_id").agg(
        _in_order(F.when(~is_test, F.struct("file", "line", "context"))).alias("callers"),
        _in_order(F.when(is_test, F.struct("file", "line", "context", "enclosing_test"))).alias("tests"),
    )
    imported = _top(imported_from, shown_importers, ["file"]).groupBy("request_id").agg(_in_order(F.col("file")).alias("importers"))
    full = with_source(defs, corpus).join(git_info, "file", "left")
    for part in (counts, n_imports, sites_listed, imported):
        full = full.join(part, "request_id", "left")
    totals = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_callers", "n_tests", "n_importers")]
    return full.select(*defs.columns, "source_code", "last_commit_hash", "last_modified", *totals, "callers", "tests", "importers")


def list_files(file_meta: DataFrame) -> DataFrame:
    return file_meta.select("file").orderBy("file")
