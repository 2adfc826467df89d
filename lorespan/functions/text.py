"""Column functions on text: lines, tokens, folding, LIKE with ASCII case rules."""

from __future__ import annotations

import string
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character that ends a line for Python's str.splitlines.
BREAKS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
LINE_BREAK = rf"\r\n|[{BREAKS}]"
#: Line breaks but for the line feed.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
TOKEN_GAP = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]++"
# Words that are one token whatever their case: their letters stay letters when lowered and folded.
PLAIN_WORD = r"\A[A-Za-z0-9À-ÖØ-öø-ÿ]++\z"
# Escape character for LIKE that text does not contain, so that a backslash stays plain.
LIKE_ESCAPE = "\u0001"


def _latin_fold() -> tuple[str, str]:
    """Lower-case Latin letters with one accent, and the letters they fold to."""
    pairs = []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)
        if ch.lower() == ch and len(base) == 2 and base[0] in string.ascii_lowercase:
            pairs.append((ch, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _latin_fold()


def lines(text: Column) -> Column:
    """Array of lines; a final line break does not open another line."""
    # most texts have line feeds only, which are found without a regular expression
    mixed = reduce(or_, [F.contains(text, F.lit(c)) for c in OTHER_BREAKS])
    split = F.when(mixed, F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
    # what follows a final break is no line; a function of an array's only element splits the text once
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.get(F.transform(F.array(split), whole), 0)


def first_line(text: Column) -> Column:
    """The first of a text's lines, null if it has none."""
    return F.when(text != "", F.regexp_extract(text, f"\\A[^{BREAKS}]*+", 0))


def lines_with_ends(text: Column) -> Column:
    """Array of lines with their line breaks; a last line may have none."""
    return F.regexp_extract_all(text, F.lit(f"[^{BREAKS}]*+(?:\\r\\n|[{BREAKS}])|[^{BREAKS}]++"), F.lit(0))


def words(text: Column) -> Column:
    """Letter / digit runs of the text, in their own case."""
    return F.array_remove(F.split(text, TOKEN_GAP), "")


def first_word(text: Column) -> Column:
    """The first of a text's words, empty if it has none."""
    return F.regexp_extract(text, WORD, 0)


def has_words(text: Column) -> Column:
    """Has the text two words or more?"""
    return F.rlike(text, F.lit(r"[\p{L}\p{N}][^\p{L}\p{N}]++[\p{L}\p{N}]"))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def fold(text: Column) -> Column:
    """Lower case without Latin accents: what the index and the queries compare."""
    return F.when(_ascii(text), F.lower(text)).otherwise(F.translate(F.lower(text), FOLD_FROM, FOLD_TO))


def unaccented(token: Column) -> Column:
    """A token of ``lower_tokens`` as ``index_tokens`` has it."""
    return F.when(_ascii(token), token).otherwise(F.translate(token, FOLD_FROM, FOLD_TO))


def index_tokens(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.rlike(whole, F.lit(PLAIN_WORD)), F.array(fold(whole))).otherwise(words(fold(whole)))


def lower_tokens(text: Column) -> Column:
    """``index_tokens`` with their accents: letters stay letters without these, so that they part at the same places."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.rlike(whole, F.lit(PLAIN_WORD)), F.array(F.lower(whole))).otherwise(words(F.lower(whole)))


def n_tokens(text: Column) -> Column:
    """The number of ``index_tokens``."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.rlike(whole, F.lit(PLAIN_WORD)), F.lit(1)).otherwise(F.size(words(F.lower(whole))))


def each_n_tokens(names: Column) -> Column:
    """``n_tokens`` of each element of an array; one look at all of them tells whether each is a plain word."""
    joined = F.array_join(names, "\n", "\0")
    apart = F.length(joined) - F.length(F.replace(joined, F.lit("\n"), F.lit(""))) == F.size(names) - 1
    plain = F.rlike(joined, F.lit(PLAIN_WORD.replace("]", "\\n]"))) & apart & ~F.array_contains(names, "")
    return F.when(plain, F.array_repeat(F.lit(1), F.size(names))).otherwise(F.transform(names, n_tokens))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def like_ascii_ci(text: Column, pattern: Column) -> Column:
    """LIKE that ignores the case of ASCII letters only; % and _ are wildcards, \\ is plain."""
    return F.like(ascii_lower(text), ascii_lower(pattern), F.lit(LIKE_ESCAPE))


def rtrim_space(text: Column) -> Column:
    # a text that ends otherwise has nothing to lose; the breaks are those that "$" stands before
    return F.when(F.rlike(F.right(text, F.lit(1)), F.lit(r"[\s\x0B\x{85}\x{2028}\x{2029}]")), F.regexp_replace(text, r"[\s\x0B]+$", "")).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.length(text) / 4).cast("bigint")


def unfold(df: DataFrame, keep: list, array: Column | str, pos: str, value: str) -> DataFrame:
    """One row per element of an array, numbered from 0.

    The outer form with a check of the number does what ``posexplode`` does, but keeps Spark from
    inferring a filter on the array's size, which would compute the array a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())
