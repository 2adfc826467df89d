"""Ranked full-text search (BM25) over definitions and call sites.

An index is a posting table ``(row key, col, pos, tok)``. Postings of definitions hold ``dl`` too, the token count of the
row, so scoring these needs no second table; calls take it from their line. Beside it lie the vocabulary, each token once, and the totals of the corpus.
Query terms first meet the vocabulary: exact tokens on the token, prefix terms on its leading characters of the
lengths that occur among the terms. The tokens found are written down, so their size is known when postings are
joined on whole tokens: Spark broadcasts them when they are small, and only matching postings are shuffled.

Call sites of one line share file and context. These are matched once per line; bounds rule most lines out, and only
the calls of the lines left are scored, so the work follows the text and not its square.

Where queries meet most rows (``whole=True``), bounds come from going through the rows (``scan``), and postings are asked
for the rows left.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import regex
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import text
from lorespan.operators import scan
from lorespan.session import stored

# BM25 parameters, the floor of a term weight, default number of hits.
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
LIMIT = 15
# So many hits of all queries at most are few: they are not written down.
FEW = 10_000
EDGE_PUNCTUATION = r".,;:!?\"'()\[\]{}"

SYMBOL_TEXT = ("name", "kind", "file", "signature")
SYMBOL_KEY = ("file", "no")
CALL_KEY = ("file", "line", "no")
LINE_KEY = ("file", "line")
TOTALS = ("symbol_rows", "symbol_tokens", "call_rows", "call_tokens")
_FOLD = str.maketrans(text.FOLD_FROM, text.FOLD_TO)
# Ranks are compared after rounding, so that the order of additions cannot change a result.
RANK_DIGITS = 9
# A bound may be off by so much.
SLACK = 10.0 ** (1 - RANK_DIGITS)


# ---------------------------------------------------------------- queries

def _clean_words(query: Column) -> Column:
    bare = F.transform(F.split(query, r"\s+"), lambda w: F.lower(F.regexp_replace(w, f"^[{EDGE_PUNCTUATION}]+|[{EDGE_PUNCTUATION}]+$", "")))
    return F.filter(bare, lambda w: w != "")


def match_expression(query: Column) -> Column:
    """The query as a match expression: digits are exact terms, words are prefixes, joined by OR."""
    return F.array_join(
        F.transform(
            _clean_words(query),
            lambda w: F.when(F.rlike(w, F.lit(r"^\d+$")), F.concat(F.lit('"'), w, F.lit('"'))).otherwise(F.concat(w, F.lit("*"))),
        ),
        " OR ",
    )


def query_terms(queries: DataFrame, strict_syntax: bool = False) -> DataFrame:
    """Terms of (query_id, query): one row per token, tokens of a term are adjacent in the text.

    A word with punctuation inside is a phrase of its tokens. With ``strict_syntax`` such a word
    empties its whole query.
    """
    words = queries.select("query_id", _clean_words(F.col("query")).alias("words"))
    if strict_syntax:
        words = words.filter(~F.exists("words", lambda w: F.rlike(w, F.lit(r"[\x01-\x7f&&[^A-Za-z0-9_]]"))))
    terms = words.select("query_id", F.posexplode("words").alias("term_no", "word")).select(
        "query_id",
        "term_no",
        F.rlike("word", F.lit(r"^\d+$")).alias("exact"),
        text.index_tokens(F.col("word")).alias("toks"),
    )
    return terms.select(
        "query_id", "term_no", "exact", F.size("toks").alias("n_toks"), F.posexplode("toks").alias("tok_no", "tok")
    ).select(
        "query_id", "term_no", "n_toks", "tok_no", "tok",
        (~F.col("exact") & (F.col("tok_no") == F.col("n_toks") - 1)).alias("is_prefix"),
    )


@dataclass(frozen=True)
class Term:
    """One token of a term of a query text."""

    term_no: int
    n_toks: int
    tok_no: int
    tok: str
    is_prefix: bool


def parse_query(query: str) -> list[Term]:
    """Terms of one query text, by the rules of ``query_terms``."""
    out: list[Term] = []
    words = [w.strip(".,;:!?\"'()[]{}").lower() for w in query.split()]
    for no, word in enumerate(w for w in words if w):
        exact = regex.fullmatch(r"[0-9]+", word) is not None
        toks = regex.findall(r"[\p{L}\p{N}]+", word.translate(_FOLD))
        out += [Term(no, len(toks), i, t, not exact and i == len(toks) - 1) for i, t in enumerate(toks)]
    return out


def literal_terms(spark: SparkSession, query: str) -> DataFrame:
    """Terms of one query text as a constant table, which the optimizer sees through."""
    rows = parse_query(query)
    columns = "query_id, term_no, n_toks, tok_no, tok, is_prefix"
    types = "CAST(0 AS BIGINT), CAST(%d AS INT), CAST(%d AS INT), CAST(%d AS INT), '%s', %s"
    if not rows:
        empty = types % (0, 0, 0, "", "false")
        return spark.sql(f"SELECT * FROM VALUES ({empty}) AS t({columns}) WHERE false")
    values = ", ".join("(" + types % (t.term_no, t.n_toks, t.tok_no, t.tok, str(t.is_prefix).lower()) + ")" for t in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def token_filter(query: str) -> Column:
    """Predicate on ``tok`` for the tokens a query can match. On stored postings it reaches the scan."""
    keep = F.lit(False)
    for t in parse_query(query):
        keep = keep | (F.startswith(F.col("tok"), F.lit(t.tok)) if t.is_prefix else F.col("tok") == t.tok)
    return keep


# ---------------------------------------------------------------- index

def _size(c: Column | str) -> Column:
    return text.n_tokens(F.col(c) if isinstance(c, str) else c)


def _row_length(columns) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + _size(c)
    return total


def _explode_tokens(rows: DataFrame, keep, columns) -> DataFrame:
    toks = [text.lower_tokens(F.col(c)).alias("toks") for c in columns]
    if len(columns) == 1:
        cells = rows.select(*keep, F.lit(0).alias("col"), *toks)
    else:
        cells = rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(i).alias("col"), c) for i, c in enumerate(toks)])))
    return text.unfold(cells, [*keep, "col"], "toks", "pos", "tok").withColumn("tok", text.unaccented(F.col("tok")))


def measured_symbols(symbols: DataFrame) -> DataFrame:
    """Definitions with ``dl``, their number of tokens."""
    return symbols.withColumn("dl", _row_length(SYMBOL_TEXT))


def measured_lines(call_lines: DataFrame) -> DataFrame:
    """Call lines with ``dl``, the tokens all calls of a line share, and ``own``, those of each name."""
    return call_lines.select("*", _row_length(("file", "context")).alias("dl"), text.each_n_tokens(F.col("refs")["name"]).alias("own"))


def symbol_postings(measured: DataFrame) -> DataFrame:
    """One row per token of the four text columns of a definition."""
    return _explode_tokens(measured, (*SYMBOL_KEY, "dl"), SYMBOL_TEXT)


def line_postings(measured: DataFrame) -> DataFrame:
    """Tokens that all calls of a line share: its file and its context."""
    return _explode_tokens(measured.withColumn("_path", F.col("file")), LINE_KEY, ("_path", "context"))


def name_postings(measured: DataFrame) -> DataFrame:
    """Tokens of the called names."""
    named = text.unfold(measured, list(LINE_KEY), F.col("refs")["name"], "no", "name")
    return _explode_tokens(named, CALL_KEY, ("name",))


def postings(symbols: DataFrame, call_lines: DataFrame) -> dict[str, DataFrame]:
    """The posting tables of measured definitions and call lines, by name."""
    return {"symbol_postings": symbol_postings(symbols), "line_postings": line_postings(call_lines), "name_postings": name_postings(call_lines)}


def by_token(posted: DataFrame) -> DataFrame:
    """Postings laid out by token within each task, so that a query reads the pages of its tokens only. Nothing is shuffled:
    a token that holds much of the corpus is spread like the rows it stands in."""
    return posted.sortWithinPartitions("tok")


def vocabulary(posted) -> DataFrame:
    """Each token of some posting tables once."""
    first, *rest = [df.select("tok") for df in posted]
    for df in rest:
        first = first.unionByName(df)
    return first.distinct()


def row_lengths(symbols: DataFrame, call_lines: DataFrame) -> DataFrame:
    """``(file, symbol_rows, symbol_tokens, call_rows, call_tokens)`` to be summed up; calls of a line are counted without
    listing them."""
    none, n = F.lit(0).cast("bigint"), F.size("own").cast("bigint")
    names = F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x)
    of_symbols = symbols.select("file", F.lit(1).cast("bigint"), F.col("dl").cast("bigint"), none, none)
    of_calls = call_lines.select("file", none, none, n, n * F.col("dl") + names)
    return of_symbols.union(of_calls).toDF("file", *TOTALS)


def summed(lengths: DataFrame, *keys: str) -> DataFrame:
    return lengths.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS])


@dataclass(frozen=True)
class TextIndex:
    """The tables a search reads; ``totals`` is one row."""

    symbols: DataFrame
    call_lines: DataFrame
    symbol_postings: DataFrame
    line_postings: DataFrame
    name_postings: DataFrame
    vocabulary: DataFrame
    totals: DataFrame

    @staticmethod
    def of(symbols: DataFrame, call_lines: DataFrame) -> TextIndex:
        s, c = measured_symbols(symbols), measured_lines(call_lines)
        posted = postings(s, c)
        return TextIndex(s, c, **posted, vocabulary=vocabulary(posted.values()), totals=summed(row_lengths(s, c)))

    @staticmethod
    def build(spark: SparkSession, symbols: DataFrame, call_lines: DataFrame, path: str) -> TextIndex:
        """Writes the index. The texts are extracted once; all else is made from what was written."""

        def written(name: str, df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        s, c = written("symbols", measured_symbols(symbols)), written("call_lines", measured_lines(call_lines))
        posted = {name: written(name, by_token(df)) for name, df in postings(s, c).items()}
        written("vocabulary", vocabulary(posted.values()).sortWithinPartitions("tok"))
        written("totals", summed(row_lengths(s, c)))
        return TextIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(TextIndex)])

    def only(self, prune: Column | None) -> TextIndex:
        """The index with postings and vocabulary cut down to some tokens (``token_filter``)."""
        if prune is None:
            return self
        cut = ("symbol_postings", "line_postings", "name_postings", "vocabulary")
        return replace(self, **{name: getattr(self, name).filter(prune) for name in cut})


# ---------------------------------------------------------------- matching

@dataclass(frozen=True)
class _Asked:
    """What queries ask for, each term once: ``times`` (query_id, term, times) says how often a query has a term, ``parts``
    (term, parts) what tokens a term is made of, ``tokens`` (term, n_toks, tok_no, tok) which tokens of the vocabulary each
    of them stands for, ``totals`` are those of the corpus, ``queries`` is the number of queries. All are written down, so that
    plans know their size and compute them once."""

    times: DataFrame
    parts: DataFrame
    tokens: DataFrame
    totals: Row
    queries: int


def _asked(index: TextIndex, terms: DataFrame) -> _Asked:
    parts = F.sort_array(F.collect_list(F.struct("tok_no", "tok", "is_prefix")))
    whole = terms.groupBy("query_id", "term_no").agg(parts.alias("parts"))
    name = F.array_join(F.transform("parts", lambda x: F.when(x["is_prefix"], F.concat(x["tok"], F.lit("*"))).otherwise(x["tok"])), " ")
    named = stored(whole.select("query_id", name.alias("term"), "parts"), "search_terms")
    times = stored(named.groupBy("query_id", "term").agg(F.count("*").alias("times")), "search_times")
    distinct = named.groupBy("term").agg(F.first("parts").alias("parts"))
    return _Asked(times, distinct, _matched_tokens(distinct, index.vocabulary), index.totals.first(), times.select("query_id").distinct().count())


def _matched_tokens(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(term, n_toks, tok_no, tok)`` for the parts of each term, with the tokens of the vocabulary they stand for."""
    keyed = terms.select("term", F.size("parts").alias("n_toks"), F.explode("parts").alias("p")).select(
        "term", "n_toks", "p.tok_no", F.col("p.tok").alias("head"), F.when(F.col("p.is_prefix"), F.length("p.tok")).otherwise(F.lit(0)).alias("cut"),
    )
    cuts = keyed.agg(F.collect_set("cut")).scalar()
    head = F.when(F.col("cut") == 0, F.col("tok")).otherwise(F.substring(F.col("tok"), F.lit(1), F.col("cut")))
    heads = vocabulary.select("tok", F.explode(cuts).alias("cut")).filter(F.col("cut") <= F.length("tok")).withColumn("head", head)
    return stored(heads.join(keyed, ["cut", "head"]).select("term", "n_toks", "tok_no", "tok"), "search_tokens")


def term_counts(posted: DataFrame, tokens: DataFrame, key) -> DataFrame:
    """(term, row key, f): occurrences of each term in each row that has it, with ``dl`` where postings hold it.

    The tokens of a phrase are counted per place where it would begin, single tokens all together, in one pass.
    """
    ids = ["term", *key]
    dl = [F.max("dl").alias("dl")] if "dl" in posted.columns else []
    begins = F.when(F.col("n_toks") > 1, F.struct("col", (F.col("pos") - F.col("tok_no")).alias("pos")))
    hits = posted.join(tokens, "tok").select(*ids, *(["dl"] if dl else []), "n_toks", begins.alias("begins"))
    places = hits.repartition(*ids).groupBy(*ids, "n_toks", "begins").agg(*dl, F.count("*").alias("n"))
    found = places.filter((F.col("n_toks") == 1) | (F.col("n") == F.col("n_toks")))
    return found.groupBy(*ids).agg(*dl, F.sum(F.when(F.col("n_toks") == 1, F.col("n")).otherwise(F.lit(1))).alias("f"))


def _weights(having: DataFrame, rows: int) -> DataFrame:
    """``(term, idf)`` from ``(term, n)``, the rows that have a term."""
    idf = F.ln((rows - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return having.select("term", F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR)).alias("idf"))


def _part(f: Column, dl: Column, mean: float) -> Column:
    """A term's part in the score of a row."""
    f = f.cast("double")
    return F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def _placed(scored: DataFrame, key, limit: int, few: bool = False) -> DataFrame:
    """First ``limit`` rows per query by rank. Spark applies the group limit before the shuffle too, so a query that
    matches most rows still sends only ``limit`` rows per task. They are broadcast if known to be few, else written down: plans
    know their size, so the texts that they are joined with are not shuffled."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", *key))
    best = scored.withColumn("place", place).filter(F.col("place") <= limit)
    return F.broadcast(best) if few else stored(best, "search_best")


def _kept(bounded: DataFrame, key, limit: int) -> DataFrame:
    """``(query_id, key)`` of the rows whose upper bound reaches the lower bounds of enough calls of the query."""
    best = W.partitionBy("query_id").orderBy(F.desc("low"), *key)
    first = bounded.filter("low > 0").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit)
    reached = first.withColumn("sum", F.sum("calls").over(best.rowsBetween(W.unboundedPreceding, W.currentRow))).filter(F.col("sum") >= limit)
    needed = reached.groupBy("query_id").agg(F.max("low").alias("needed"))
    kept = bounded.join(needed, "query_id", "left").filter(F.col("needed").isNull() | (F.col("high") >= F.col("needed") - SLACK))
    return stored(kept.select("query_id", *key), "search_kept")


def _among(rows: DataFrame, keys: DataFrame, key, how: str = "left_semi") -> DataFrame:
    """Rows of some keys, or of all others; nulls are equal."""
    other = keys.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, same, how)


@dataclass(frozen=True)
class _Scanned:
    """Rows of keys that stand once, gone through for all queries at once."""

    rows: DataFrame
    key: tuple[str, ...]
    asked: _Asked
    terms: list[Row]
    mean: float

    @staticmethod
    def of(rows: DataFrame, key, asked: _Asked, mean: float) -> _Scanned:
        terms = asked.parts.orderBy("term").collect()  # no more than the queries have
        parts = [tuple((p.tok, p.is_prefix) for p in r.parts) for r in terms]
        return _Scanned(stored(scan.counted(rows, key, parts), "search_counted"), tuple(key), asked, terms, mean)

    def having(self) -> DataFrame:
        """``(term, n)``, the calls that have a term."""
        names = self.rows.sparkSession.createDataFrame([(i, r.term) for i, r in enumerate(self.terms)], "no int, name string")
        found = scan.having(self.rows, len(self.terms))
        return found.join(names, found["term"] == names["no"]).select(names["name"].alias("term"), "n")

    def bounded(self, weights: DataFrame, limit: int) -> DataFrame:
        number = {r.term: i for i, r in enumerate(self.terms)}
        of_query: dict[object, dict[int, float]] = {}
        for r in self.asked.times.join(weights, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w")).collect():
            of_query.setdefault(r.query_id, {})[number[r.term]] = r.w
        mean = self.mean

        def part(f, dl):
            return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))

        return scan.bounded(self.rows, self.key, of_query, len(self.terms), self.asked.times.schema["query_id"].dataType, limit, SLACK, part)


def _repeated(rows: DataFrame, key) -> DataFrame:
    """Keys of more than one row, and keys that hold a null: postings do not tell these rows apart."""
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    return stored(rows.groupBy(*key).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | null).select(*key), "search_repeated")


def _symbols(index: TextIndex, asked: _Asked, limit: int, whole: bool = False) -> DataFrame:
    rows, mean = asked.totals.symbol_rows, asked.totals.symbol_tokens / max(asked.totals.symbol_rows, 1)
    # Counting over dl and f keeps both columns in the plan: Spark then reuses the shuffle of ``counts``.
    having = lambda counts: counts.groupBy("term").agg(F.count(F.col("dl") + F.col("f")).alias("n"))

    def scored(counts: DataFrame, weights: DataFrame) -> DataFrame:
        parts = counts.join(weights, "term").select("term", *SYMBOL_KEY, _part(F.col("f"), F.col("dl"), mean).alias("part"))
        return parts.join(asked.times, "term").groupBy("query_id", *SYMBOL_KEY).agg(F.sum(F.col("times") * F.col("part")).alias("score"))

    if not whole:
        counts = term_counts(index.symbol_postings, asked.tokens, SYMBOL_KEY)
        found = scored(counts, _weights(having(counts), rows))
    else:
        repeated, one = _repeated(index.symbols, SYMBOL_KEY), F.lit(1)
        once = _among(index.symbols, repeated, SYMBOL_KEY, "left_anti").select(
            *SYMBOL_KEY, one.alias("calls"), F.col("dl").alias("longest"), F.col("dl").alias("least"),
            F.array(*[text.index_tokens(F.col(c)) for c in SYMBOL_TEXT]).alias("cols"), F.array().cast("array<array<string>>").alias("names"),
        )
        scanned = _Scanned.of(once, SYMBOL_KEY, asked, mean)
        others = stored(term_counts(_among(index.symbol_postings, repeated, SYMBOL_KEY), asked.tokens, SYMBOL_KEY), "search_others")
        weights = stored(_weights(scanned.having().unionByName(having(others)).groupBy("term").agg(F.sum("n").alias("n")), rows), "search_weights")
        apart = scored(others, weights).select("query_id", *SYMBOL_KEY, one.alias("calls"), F.col("score").alias("low"), F.col("score").alias("high"))
        kept = _kept(stored(scanned.bounded(weights, limit).unionByName(apart), "search_bounds"), SYMBOL_KEY, limit)
        counts = term_counts(_among(index.symbol_postings, kept, SYMBOL_KEY), asked.tokens, SYMBOL_KEY)
        found = _among(scored(counts, weights), kept, ("query_id", *SYMBOL_KEY))
    ranked = found.select("query_id", *SYMBOL_KEY, F.round(-F.col("score"), RANK_DIGITS).alias("rank"))
    few = not whole and asked.queries * limit <= FEW
    return index.symbols.join(_placed(ranked, SYMBOL_KEY, limit, few), list(SYMBOL_KEY))


def _of_lines(index: TextIndex, lines: DataFrame) -> TextIndex:
    """The index with call lines and their postings cut down to some lines."""
    cut = ("call_lines", "line_postings", "name_postings")
    return replace(index, **{name: _among(getattr(index, name), lines, LINE_KEY) for name in cut})


def _met(index: TextIndex, asked: _Asked) -> tuple[DataFrame, DataFrame]:
    """Names that have a term, ``(term, key of the call, f)``, and lines that a term meets, ``(term, key of the line, f,
    most, named, dl, calls, least, longest)``: ``f`` counts what all calls of the line share, ``most`` is the most that one of its
    names has, ``named`` the number of names."""
    line = list(LINE_KEY)
    names = stored(term_counts(index.name_postings, asked.tokens, CALL_KEY).select("term", *CALL_KEY, "f"), "search_names")
    of_names = names.groupBy("term", *line).agg(F.max("f").alias("most"), F.count("*").alias("named")).withColumn("f", F.lit(0).cast("bigint"))
    of_lines = term_counts(index.line_postings, asked.tokens, LINE_KEY).select("term", *line, "f", F.lit(0).cast("bigint").alias("most"), F.lit(0).cast("bigint").alias("named"))
    both = of_lines.unionByName(of_names.select(*of_lines.columns)).groupBy("term", *line).agg(*[F.max(c).alias(c) for c in ("f", "most", "named")])
    lengths = index.call_lines.select(*line, "dl", F.size("own").alias("calls"), F.array_min("own").alias("least"), F.array_max("own").alias("longest"))
    return names, stored(both.join(lengths, line), "search_lines")


def _calls(index: TextIndex, asked: _Asked, limit: int, whole: bool = False) -> DataFrame:
    """Calls by rank: those of few lines, as most lines are ruled out by bounds.

    All calls of a line share its terms; a call's own name can only add to these, and its length differs by the length of
    its name. So each line has a score that none of its calls is below, and one that none is above. Lines whose upper
    bound is below the lower bounds of enough calls of the query are left out; the calls of the others are scored.
    """
    line = list(LINE_KEY)
    rows, mean = asked.totals.call_rows, asked.totals.call_tokens / max(asked.totals.call_rows, 1)

    def having(met: DataFrame) -> DataFrame:
        return met.groupBy("term").agg(F.sum(F.when(F.col("f") > 0, F.col("calls")).otherwise(F.col("named"))).alias("n"))

    def bounds(met: DataFrame, weights: DataFrame) -> DataFrame:
        low = _part(F.col("f"), F.col("dl") + F.col("longest"), mean)
        high = _part(F.col("f") + F.col("most"), F.col("dl") + F.col("least"), mean)
        parts = met.join(weights, "term").select("term", *line, "calls", low.alias("low"), high.alias("high")).join(asked.times, "term")
        sums = [F.sum(F.col("times") * F.col(c)).alias(c) for c in ("low", "high")]
        return parts.groupBy("query_id", *line).agg(F.max("calls").alias("calls"), *sums)

    if not whole:
        names, met = _met(index, asked)
        weights = stored(_weights(having(met), rows), "search_weights")
        kept = _kept(stored(bounds(met, weights), "search_bounds"), line, limit)
    else:
        repeated = _repeated(index.call_lines, line)
        once = _among(index.call_lines, repeated, line, "left_anti").filter(F.size("own") > 0).select(
            *line, F.size("own").alias("calls"), (F.col("dl") + F.array_max("own")).alias("longest"), (F.col("dl") + F.array_min("own")).alias("least"),
            F.array(text.index_tokens(F.col("file")), text.index_tokens(F.col("context"))).alias("cols"),
            F.transform(F.col("refs")["name"], text.index_tokens).alias("names"),
        )
        scanned = _Scanned.of(once, line, asked, mean)
        others = _met(_of_lines(index, repeated), asked)[1]
        weights = stored(_weights(scanned.having().unionByName(having(others)).groupBy("term").agg(F.sum("n").alias("n")), rows), "search_weights")
        kept = _kept(stored(scanned.bounded(weights, limit).unionByName(bounds(others, weights)), "search_bounds"), line, limit)
        index = _of_lines(index, kept)
        names, met = _met(index, asked)
    terms = met.join(weights, "term").join(asked.times, "term").select("query_id", "term", *line, "f", "idf", "times").join(kept, ["query_id", *line])
    sizes = index.call_lines.select(*line, "dl", "own").join(kept.select(*line).distinct(), line, "left_semi")
    each = terms.join(sizes, line).select(
        "query_id", "term", *line, "f", "idf", "times", "dl", F.posexplode("own").alias("no", "own")
    )
    own = names.withColumnRenamed("f", "own_f")
    told = each.join(own, ["term", *CALL_KEY], "left").withColumn("f", F.col("f") + F.coalesce("own_f", F.lit(0))).filter("f > 0")
    part = F.col("times") * _part(F.col("f"), F.col("dl") + F.col("own"), mean)
    scored = told.groupBy("query_id", *CALL_KEY).agg(F.round(-F.sum(part), RANK_DIGITS).alias("rank"))
    found = index.call_lines.select(*line, "context", "refs").join(_placed(scored, CALL_KEY, limit), line)
    called = F.get("refs", F.col("no"))["name"].alias("symbol_name")
    return stored(found.select("query_id", *CALL_KEY, "rank", "place", "context", called), "search_calls")


def search_symbols(index: TextIndex, terms: DataFrame, limit: int = LIMIT, whole: bool = False) -> DataFrame:
    """Best definitions per query; ties by file and position in the file."""
    return _symbols(index, _asked(index, terms), limit, whole)


def search_calls(index: TextIndex, terms: DataFrame, limit: int = LIMIT, whole: bool = False) -> DataFrame:
    """Best call sites per query; ties by file, line and position in the line."""
    return _calls(index, _asked(index, terms), limit, whole)


def search(index: TextIndex, terms: DataFrame, limit: int = LIMIT, whole: bool = False) -> DataFrame:
    """Definitions and call sites merged: one row per definition, or per call without one.

    A definition found directly keeps its rank and takes the context of its best call; one found
    through calls takes the rank of the best call. The limit holds for both passes and the result.
    With ``whole`` rows are gone through instead of postings: for many queries that meet most rows.
    """
    asked = _asked(index, terms)
    direct, calls = _symbols(index, asked, limit, whole), _calls(index, asked, limit, whole)
    called = calls.select(F.col("symbol_name").alias("name")).distinct()
    first_def = (
        index.symbols.join(called, "name", "left_semi")
        .groupBy("name")
        .agg(F.min(F.struct("file", "start_line", "no", "end_line", "kind", "signature", "language")).alias("d"))
    )
    linked = calls.join(first_def, calls["symbol_name"] == first_def["name"], "left")
    known = F.col("d").isNotNull()
    own = F.coalesce("context", F.lit(""))
    by_call = linked.select(
        "query_id",
        F.coalesce("d.file", linked["file"]).alias("file"),
        "symbol_name",
        F.when(known, F.col("d.start_line")).otherwise(F.col("line")).alias("start_line"),
        F.when(known, F.col("d.end_line")).otherwise(F.col("line")).alias("end_line"),
        F.when(known, F.col("d.kind")).otherwise(F.lit("call")).alias("kind"),
        F.when(known, F.coalesce("d.signature", F.lit(""))).otherwise(own).alias("signature"),
        F.when(known, F.col("d.language")).otherwise(F.lit("")).alias("language"),
        F.lit(1).alias("pass"), "rank", "place",
        own.alias("call_context"), F.col("line").alias("call_line"),
    ).withColumnRenamed("symbol_name", "name")
    by_symbol = direct.select(
        "query_id", "file", "name", "start_line", "end_line", "kind", F.coalesce("signature", F.lit("")).alias("signature"), "language",
        F.lit(0).alias("pass"), "rank", "place", F.lit("").alias("call_context"), F.lit(0).alias("call_line"),
    )
    order = F.struct("pass", "place")
    with_text = F.when(F.col("call_context") != "", order)
    merged = (
        by_symbol.unionByName(by_call)
        .groupBy("query_id", "file", "name", "start_line")
        .agg(
            F.min_by(F.struct("end_line", "kind", "signature", "language", "rank"), order).alias("r"),
            F.min_by(F.struct("call_context", "call_line"), with_text).alias("c"),
            F.max_by("call_line", order).alias("last_line"),
        )
        .select(
            "query_id", "file", "name", "start_line", "r.*",
            F.coalesce("c.call_context", F.lit("")).alias("call_context"),
            F.coalesce("c.call_line", "last_line").alias("call_line"),
        )
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "file", "start_line", "name"))
    return merged.withColumn("place", place).filter(F.col("place") <= limit)


def hits_by_file(hits: DataFrame) -> DataFrame:
    """Listing of a result grouped by file, in the order of each file's first hit."""
    return (
        hits.groupBy("query_id", "file")
        .agg(
            F.min("place").alias("first_place"),
            F.count("*").alias("hits"),
            F.sort_array(F.collect_list(F.struct("place", "start_line", "kind", "name", "signature", "call_line", "call_context"))).alias("items"),
        )
        .orderBy("query_id", "first_place")
    )
