"""Adapter that reads prose as an index: the same relations as for code, from plain text.

Every line with a word defines its first word, refers to the others and spans to the line before the
next definition; words of line 1 are imports. A file is one row of at most 1 MB, so all of it is
array work inside the row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.functions import text


def _lines(corpus: DataFrame, *carried: str) -> DataFrame:
    return corpus.select("file", *carried, text.lines(F.col("content")).alias("_lines"))


def line_table(corpus: DataFrame, *carried: str) -> DataFrame:
    rows = text.unfold(_lines(corpus, *carried), ["file", *carried], "_lines", "_pos", "text")
    return rows.select("file", *carried, (F.col("_pos") + 1).alias("line"), "text")


def definitions(corpus: DataFrame) -> DataFrame:
    """Columns of the symbols relation; ``no`` numbers the definitions of a file."""
    numbered = F.transform(
        "_lines", lambda t, i: F.struct((i + 1).alias("line"), t.alias("text"), text.first_word(t).alias("name"))
    )
    found = _lines(corpus, "language").select(
        "file", "language", F.size("_lines").alias("_n"), F.filter(numbered, lambda d: d["name"] != "").alias("_defs")
    )
    next_start = F.concat(
        F.transform(F.slice("_defs", 2, F.greatest(F.size("_defs"), F.lit(1))), lambda d: d["line"]), F.array(F.col("_n") + 1)
    )
    spans = F.zip_with(
        "_defs", F.slice(next_start, 1, F.size("_defs")), lambda d, nxt: F.struct(d["name"].alias("name"), d["line"].alias("start_line"), (nxt - 1).alias("end_line"), d["text"].alias("text"))
    )
    rows = text.unfold(found, ["file", "language"], spans, "no", "d")
    first = F.substring(F.col("d.name"), 1, 1)
    return rows.select(
        F.col("d.name").alias("name"),
        F.when((F.upper(first) == first) & (F.lower(first) != first), F.lit("class")).otherwise(F.lit("function")).alias("kind"),
        "file",
        F.col("d.start_line").alias("start_line"),
        F.col("d.end_line").alias("end_line"),
        text.rtrim_space(F.col("d.text")).alias("signature"),
        "language",
        "no",
    )


def call_lines(corpus: DataFrame) -> DataFrame:
    """References grouped by line: (file, line, context, refs). See ``extract.explode_calls``."""
    return (
        line_table(corpus)
        .filter(text.has_words(F.col("text")))
        .select("file", "line", "text", text.words(F.col("text")).alias("w"))
        .select(
            "file",
            "line",
            text.rtrim_space(F.col("text")).alias("context"),
            F.transform(F.slice("w", 2, F.size("w")), lambda x: F.struct(x.alias("name"), x.alias("full_name"))).alias("refs"),
        )
    )


def imports(corpus: DataFrame) -> DataFrame:
    first = text.first_line(F.col("content"))
    heads = corpus.select("file", F.trim(first).alias("import_line"), text.words(first).alias("w"))
    return text.unfold(heads, ["file", "import_line"], "w", "_pos", "symbol_name").select("symbol_name", "file", "import_line")
