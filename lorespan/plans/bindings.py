"""How the operators' relations are read from the generic tables of a data folder."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import text
from lorespan.operators import prose, telemetry
from lorespan.operators.search import TextIndex
from lorespan.session import scratch_dir
from lorespan.sources import corpus as corpus_source
from lorespan.sources.index_store import IndexStore, refresh

# Roles of event types and the instant "now" stands for.
INDEX_EVENTS = ("signup", "error")
RECALL_EVENT = "purchase"
RESOLVE_EVENT = "view"
AS_OF = "2024-01-30 12:00:00"
AS_OF_EPOCH = 1706616000.0
# Definitions whose name starts so play the part of tests.
TEST_PREFIX = "e"
ENTRY_NAMES = ("test_0.txt", *(f"{i}.txt" for i in range(1, 14)))
QUERY = "src3/en theand 404 aucheau"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _path(doc_id, folder: str = "source"):
    prefix = F.when(F.col("doc_id") % 20 == 0, F.lit("test_")).otherwise(F.lit(""))
    return F.concat_ws("/", F.col(folder), F.col("lang"), F.concat(prefix, F.col(doc_id).cast("string"), F.lit(".txt")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<lang>/<id>.txt, every twentieth one named as a test."""
    return documents(spark, sf_dir).select(
        "doc_id",
        _path("doc_id").alias("file"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.octet_length("text").alias("size"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
    )


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_source.scan_corpus(corpus(spark, sf_dir), language=F.col("language"), test_rules=F.lit("python"))


def indexable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus within the size limit: what every index operator reads."""
    return scanned(spark, sf_dir).filter(~F.col("too_big"))


def previous_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the corpus: some files had other text, some did not exist, some are gone now."""
    docs = documents(spark, sf_dir)
    older = F.when(
        F.col("doc_id") % 10 == 3, F.concat(F.lit("Older version.\n"), F.replace("text", F.lit(" an "), F.lit(" one ")))
    ).otherwise(F.col("text"))
    kept = docs.filter(F.col("doc_id") % 10 != 7).select(_path("doc_id").alias("file"), F.col("lang").alias("language"), older.alias("content"))
    gone = docs.filter(F.col("doc_id") % 10 == 5).withColumn("removed", F.lit("removed")).select(
        _path("doc_id", "removed").alias("file"), F.col("lang").alias("language"), F.col("text").alias("content")
    )
    return kept.unionByName(gone).withColumn("content_hash", F.sha2(F.col("content"), 256))


EXTRACTORS = {"symbols": prose.definitions, "call_lines": prose.call_lines, "imports": prose.imports}


def _meta(rows: DataFrame) -> DataFrame:
    return corpus_source.file_meta(rows, F.lit(AS_OF_EPOCH))


def run_index(store: IndexStore, corpus: DataFrame, gone: DataFrame | None, version: int, incremental: bool) -> None:
    """One index run over prose files; ``gone`` are files that are no longer there."""
    gone = store.spark.createDataFrame([], "file string") if gone is None else gone
    refresh(store, corpus, gone, version, EXTRACTORS, _meta, incremental)


def build_index(spark: SparkSession, sf_dir: str, path: str) -> IndexStore:
    """Index run over the whole corpus: definitions, references, imports and all that lookups read."""
    store = IndexStore(spark, path).create()
    run_index(store, indexable(spark, sf_dir), None, 1, incremental=False)
    return store


def build_previous(spark: SparkSession, sf_dir: str, path: str) -> IndexStore:
    """Index of the earlier state of the corpus."""
    store = IndexStore(spark, path).create()
    run_index(store, corpus_source.scan_corpus(previous_corpus(spark, sf_dir).withColumn("size", F.octet_length("content")), language=F.col("language")).filter(~F.col("too_big")), None, 1, incremental=False)
    return store


def refresh_index(store: IndexStore, sf_dir: str, version: int = 2) -> None:
    """Brings the index of the earlier state up to the present one."""
    gone = previous_corpus(store.spark, sf_dir).select("file").join(corpus(store.spark, sf_dir).select("file"), "file", "left_anti")
    run_index(store, indexable(store.spark, sf_dir), gone, version, incremental=True)


_built: dict[tuple[str, str], str] = {}


def index_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the index of a data folder lies; the first query of an application builds it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        path = scratch_dir(spark, "index")
        build_index(spark, sf_dir, path)
        _built[key] = path
    return _built[key]


def store(spark: SparkSession, sf_dir: str) -> IndexStore:
    return IndexStore(spark, index_path(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return store(spark, sf_dir).text_index()


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).relation("symbols")


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).relation("call_lines")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).imports()


def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_source.file_meta(indexable(spark, sf_dir), F.lit(AS_OF_EPOCH))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item: its whole text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to resolve: every word of the benchmark texts, as it is, in capitals, without its first letter, or made
    unknown, by its number, which is made of its MD5."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    numbered = words.select("word", F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 15), 16, 10).cast("bigint").alias("request_id"))
    kind = F.col("request_id") % 4
    variant = (
        F.when(kind == 0, F.col("word")).when(kind == 1, F.translate("word", string.ascii_lowercase, string.ascii_uppercase)).when(kind == 2, F.substr("word", F.lit(2)))
        .otherwise(F.concat("word", F.lit("zzq")))
    )
    return numbered.select("request_id", variant.alias("name"))


# Code made of the documents, a file each: languages by the text's language, a first line that imports, then a block of
# eleven lines per line of text: a function that calls one named after the line's first word (in place of {w}; {n} is the
# number of the line), a class-like type, and a method or a function beside it. The blocks are full of marks that must not
# count: quotes in comments, comment marks in strings, declarations and calls in both.
CODE = {
    "en": ("py", "from lib import tool", (
        "def f{n}(a):", "    # it's a ` and @@@ mark", "    q = '@@@' + \"/* no(\"", "    @@@doc", "    def no(): {w}(1)", "    @@@", "    return {w}_(q, \"x(\")",
        "class C{n}:", "    def m{n}(self):", "        q = 1", "",
    )),
    "fr": ("js", "import { tool } from 'lib/*x'", (
        "function f{n}(a) {", "  // it's a ` mark /* here", "  const q = '/*' + `no( ${a} \"`;", "  /* function no() {", "  no(1) */", "  return {w}_(q, \"x(\");", "}",
        "class C{n} {", "  m{n}(a) {", "  }", "}",
    )),
    "de": ("go", "import \"lib/*/tool\"", (
        "func f{n}(a int) int {", "  // it's a ` mark /* here", "  q := \"/*\" + `no( \"`", "  /* func no() {", "  no(1) */", "  return {w}_(q, \"x(\")", "}",
        "type C{n} struct {", "}", "func (c C{n}) m{n}() {", "}",
    )),
    "es": ("rs", "use lib::tool;", (
        "fn f{n}(a: &str) -> i32 {", "  // it's a ` mark /* here", "  let q = \"/*\"; let c = '\"';", "  /* fn no() {", "  no(1) */", "  return {w}_(q, \"x(\");", "}",
        "struct C{n} {", "}", "fn m{n}(a: i32) -> i32 {", "}",
    )),
}


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of code; every twentieth is named as a test of its language."""
    def by_lang(make):
        out = F.lit(None).cast("string")
        for lang, (ext, head, block) in CODE.items():
            out = F.when(F.col("lang") == lang, make(ext, head, "\n".join(block).replace("@@@", '"' * 3))).otherwise(out)
        return out

    def content(_, head, block):
        def one(line, n):
            word = F.lower(F.regexp_extract(line, "[A-Za-z]+", 0))
            named = F.replace(F.lit(block), F.lit("{w}"), F.when(word == "", F.lit("x")).otherwise(word))
            return F.replace(named, F.lit("{n}"), (n + 1).cast("string"))

        return F.concat(F.lit(head + "\n"), F.array_join(F.transform(F.split("text", "\n"), one), "\n"), F.lit("\n"))

    name = F.col("doc_id").cast("string")
    test = F.col("doc_id") % 20 == 0
    folder = F.when(test & (F.col("lang") == "es"), F.concat("source", F.lit("/tests/"))).otherwise(F.concat("source", F.lit("/")))
    before = F.when(test & (F.col("lang") == "en"), F.lit("test_")).otherwise(F.lit(""))
    after = F.when(test & (F.col("lang") == "fr"), F.lit(".test")).when(test & (F.col("lang") == "de"), F.lit("_test")).otherwise(F.lit(""))
    file = F.concat(folder, before, name, after, F.lit("."), by_lang(lambda ext, *_: F.lit(ext)))
    files = table(spark, sf_dir, "documents").select(file.alias("file"), by_lang(content).alias("content"))
    return corpus_source.scan_corpus(files.withColumn("size", F.octet_length("content")), max_bytes=1 << 30)


# A line of code per line of text: a variable that holds the line, without characters that mean something in a literal.
LITERAL_CODE = {"en": ("python", 'x = "', '"'), "fr": ("javascript", "const x = `", "`;"), "de": ("go", 'x := "', '"'), "es": ("rust", 'let x = "', '";')}
NOT_LITERAL = "\"'`\\$"


def literal_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of code whose string literals are its lines (file, language, content)."""
    def by_lang(make):
        out = F.lit(None).cast("string")
        for lang, (name, before, after) in LITERAL_CODE.items():
            out = F.when(F.col("lang") == lang, make(name, before, after)).otherwise(out)
        return out

    lines = F.split(F.translate("text", NOT_LITERAL, ""), "\n")
    content = by_lang(lambda _, before, after: F.array_join(F.transform(lines, lambda t: F.concat(F.lit(before), t, F.lit(after))), "\n"))
    docs = documents(spark, sf_dir).filter(F.col("lang").isin(*LITERAL_CODE))
    return docs.select(_path("doc_id").alias("file"), by_lang(lambda name, *_: F.lit(name)).alias("language"), content.alias("content"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a commit log of the documents."""
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("commit"), F.col("o_orderdate").alias("author_ts")
    )
    return corpus(spark, sf_dir).select("doc_id", "file").join(log, "doc_id").select("file", "commit", "author_ts")


EVENT_KEYS = {
    "tokens_saved": "k", "output_tokens": "k", "query": "k", "files_indexed": "k", "files_skipped": "k", "symbols": "k", "incremental": "k",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "event_type", "ts", F.col("value").alias("duration_ms"), F.col("user_id").alias("session"),
        F.col("props").alias("metadata"),
    )
    return telemetry.parse_events(log, "ts", "metadata", EVENT_KEYS)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reads: the type is the file, its content changes with k div 20."""
    return events(spark, sf_dir).select(
        "session", "id", "ts", F.col("event_type").alias("file"), F.floor(F.col("tokens_saved") / 20).cast("bigint").cast("string").alias("hash")
    )


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_size").cast("string").alias("name"), F.col("p_name").alias("file"), F.col("p_partkey").alias("start_line"), F.col("p_type").alias("kind")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label, as query vectors."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vec")
    ).select(F.col("label").cast("bigint").alias("query_id"), "vec")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON log lines: content is text in even sessions and a list of blocks in odd ones,
    some user records are tool results, some assistant records have no usage."""
    conv = table(spark, sf_dir, "conversations")
    n = F.length("text")
    word = F.get(text.words(F.col("text")), 0)
    sid = F.when(F.col("turn") > 0, F.col("conv_id").cast("string")).alias("sessionId")
    block = F.struct(F.lit("text").alias("type"), F.col("text"))
    plain = F.to_json(F.struct(F.lit("user").alias("type"), sid, F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(F.lit("user").alias("type"), sid, F.struct(F.array(block).alias("content")).alias("message")))
    result = F.to_json(
        F.struct(
            F.lit("user").alias("type"), sid, F.struct(F.lit(True).alias("ok")).alias("toolUseResult"),
            F.struct(F.array(F.struct(F.lit("tool_result").alias("type"))).alias("content")).alias("message"),
        )
    )
    which = n % 4
    tool = F.struct(
        F.lit("tool_use").alias("type"),
        F.lit(None).cast("string").alias("text"),
        F.when(which == 0, F.lit("Read")).when(which == 1, F.lit("index_read")).when(which == 2, F.lit("index_resolve")).otherwise(F.lit("Bash")).alias("name"),
        F.struct(
            F.when(which == 0, word).alias("file_path"), F.when(which == 1, word).alias("file"), F.when(which == 2, word).alias("symbol")
        ).alias("input"),
    )
    said = F.struct(
        F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("struct<file_path:string,file:string,symbol:string>").alias("input"),
    )
    usage = F.when(
        n % 11 != 0,
        F.struct(
            F.floor(n / 4).cast("bigint").alias("input_tokens"), F.col("turn").alias("cache_creation_input_tokens"),
            (F.col("turn") * 10).alias("cache_read_input_tokens"), F.floor(n / 8).cast("bigint").alias("output_tokens"),
        ),
    )
    answer = F.to_json(
        F.struct(F.lit("assistant").alias("type"), sid, F.struct(F.array(said, tool).alias("content"), usage.alias("usage")).alias("message"))
    )
    raw = (
        F.when(F.col("role") == "assistant", answer)
        .when(F.col("role") != "user", F.to_json(F.struct(F.lit("system").alias("type"), "text")))
        .when((F.col("conv_id") + F.col("turn")) % 7 == 0, result)
        .when(F.col("conv_id") % 2 == 0, plain)
        .otherwise(listed)
    )
    return conv.select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), raw.alias("raw"))
