"""Redaction of secrets and personal data in code, key=value files and whatever is sent from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespan.functions import paths, text
from lorespan.operators.extract import NOT_CODE, pieces

MIN_LITERAL = 6
# Stands for a line break inside a string or comment while lines are cut; a text's own mark is told apart by what follows.
_MARK = "\u0004"
_OWN, _HIDDEN = _MARK + "\u0005", _MARK + "\u0006"

# Rule detectors, in the subset Java and RE2 regular expressions share. The order breaks ties.
DETECTORS = {
    "secret": r"(?i:(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|db_pass|credential)[a-z0-9_]*[ \t]*[:=][ \t]*[\"'][^\"']{4,}[\"'])|gh[opsu]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "private_email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "account_number": r"(?:^|[^0-9A-Za-z])(?:[0-9]{12,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?:[^0-9A-Za-z]|$)",
    "private_phone": r"\+?[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}[ .-][0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
    "private_url": r"https?://[^ \t\"'<>]+",
    "private_date": r"(?:^|[^0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?:[^0-9]|$)",
}
# A line without any of these pieces cannot match its detector; looking for them is cheap.
NEEDS = {
    "secret": ('"', "'", "gho_", "ghp_", "ghs_", "ghu_", "sk-", "AKIA", "-----BEGIN "),
    "private_email": ("@",),
    "account_number": tuple("0123456789"),
    "private_phone": ("(", "+"),
    "private_url": ("://",),
    "private_date": ("-", "/"),
}
# Types that only a caller's classifier finds.
CLASSIFIER_ONLY = ("private_person", "private_address")
ENV_ACTIVE = ("secret", "account_number", "private_email")

# Entity types active by default, keys whose values are always shown.
DEFAULT_ENTITIES = ("secret", "private_email", "account_number")
DEFAULT_PASSTHROUGH = ("NODE_ENV", "PORT", "HOST", "DEBUG", "APP_ENV", "LOG_LEVEL")

_PREFIX_PY = "(?:[rRbBuU]{0,2})"
LITERAL = {
    "python": _PREFIX_PY + r"(?:\"\"\"(?:[^\"]|\"[^\"]|\"\"[^\"])*\"\"\"|'''(?:[^']|'[^']|''[^'])*'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')",
    "javascript": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`",
    "go": r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`",
    "rust": r"\"(?:\\.|[^\"\\])*\"",
}
# The same in a form that Java matches by loops: it tries the alternatives of a repeated group by recursion, a step per
# character, and a long literal overflows the stack. Alternatives begin with different characters, so nothing is given back.
_DOUBLE, _SINGLE = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"", r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
JAVA_LITERAL = {
    "python": _PREFIX_PY + r"(?:\"\"\"[^\"]*+(?:\"{1,2}+[^\"]++)*+\"\"\"|'''[^']*+(?:'{1,2}+[^']++)*+'''|" + f"{_DOUBLE}|{_SINGLE})",
    "javascript": f"{_DOUBLE}|{_SINGLE}|`[^`]*`",
    "go": f"{_DOUBLE}|`[^`]*`",
    "rust": r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"",
}
# Literals that hold expressions are left alone: a marked prefix, or a substitution inside.
INTERPOLATED = {"python": r"^[rRbBuU]*[fF]", "javascript": r"^`(?:[^`]*)\$\{"}


@dataclass(frozen=True)
class Policy:
    """What is redacted. ``watch`` / ``ignore`` / ``allow`` return a changed copy."""

    enabled: bool = False
    entity_types: tuple[str, ...] = DEFAULT_ENTITIES
    allow_patterns: tuple[str, ...] = ()
    env_passthrough_keys: tuple[str, ...] = field(default=DEFAULT_PASSTHROUGH)

    def watch(self, entity: str) -> Policy:
        return self if entity in self.entity_types else self._with(entity_types=(*self.entity_types, entity))

    def ignore(self, entity: str) -> Policy:
        return self._with(entity_types=tuple(e for e in self.entity_types if e != entity))

    def allow(self, pattern: str) -> Policy:
        return self if pattern in self.allow_patterns else self._with(allow_patterns=(*self.allow_patterns, pattern))

    def _with(self, **changes) -> Policy:
        return Policy(**{**self.__dict__, **changes})


def tag(entity: Column) -> Column:
    return F.regexp_replace(F.upper(entity), "^PRIVATE_", "")


def _may_match(line: Column, entity: str) -> Column:
    out = F.lit(False)
    for piece in NEEDS[entity]:
        out = out | F.contains(line, F.lit(piece))
    return out


def detect(line: Column, policy: Policy) -> Column:
    """First active entity type on the line, by position; null when there is none."""
    found = [
        F.when(_may_match(line, e) & F.rlike(line, F.lit(p)), F.struct(F.regexp_instr(line, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(e).alias("e")))
        for i, (e, p) in enumerate(DETECTORS.items())
        if e in policy.entity_types
    ]
    if not found:
        return F.lit(None).cast("string")
    return (F.least(*found) if len(found) > 1 else found[0])["e"]


def entity_counts(lines: DataFrame, text_col: str, keys: list[str], policy: Policy) -> DataFrame:
    """Matches of each active detector per group and entity type."""
    counts = [
        F.struct(F.lit(e).alias("entity"), F.when(_may_match(F.col(text_col), e), F.regexp_count(F.col(text_col), F.lit(p))).otherwise(0).alias("n"))
        for e, p in DETECTORS.items()
        if e in policy.entity_types
    ]
    return (
        lines.select(*keys, F.inline(F.array(*counts)))
        .filter("n > 0")
        .groupBy(*keys, "entity")
        .agg(F.sum("n").alias("matches"), F.count("*").alias("lines"))
    )


def _allowed(value: Column, policy: Policy) -> Column:
    out = F.lit(False)
    for p in policy.allow_patterns:
        out = out | F.rlike(value, F.lit(p))
    return out


def _redact_line(line: Column, lang: str, policy: Policy, found: Column | None = None) -> Column:
    """One logical line: its literals are cut out, judged by the whole line and put back.

    ``found`` is the line's entity type when something else than the detectors decided it.
    """
    pattern = JAVA_LITERAL[lang]
    if lang == "python":
        pattern = pattern.replace(_PREFIX_PY, "(?:[rRbBuUfF]{0,2})", 1)
    entity = detect(F.substring_index(line, _HIDDEN, 1), policy) if found is None else found
    literals = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    between = F.split(line, pattern)

    def judged(value: Column) -> Column:
        keep = (F.length(value) < MIN_LITERAL) | _allowed(value, policy)
        if lang in INTERPOLATED:
            keep = keep | F.rlike(value, F.lit(INTERPOLATED[lang]))
        return F.when(keep, value).otherwise(F.concat(F.lit('"[REDACTED:'), tag(entity), F.lit(']"')))

    put_back = F.zip_with(between, F.transform(literals, judged), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(entity.isNull() | (F.size(literals) == 0), line).otherwise(F.array_join(put_back, ""))


def _any_match(content: Column, policy: Policy) -> Column:
    """Does any active detector match anywhere? What a line matches, the text around it matches as well."""
    out = F.lit(False)
    for entity, pattern in DETECTORS.items():
        if entity in policy.entity_types:
            out = out | (_may_match(content, entity) & F.rlike(content, F.lit(pattern)))
    return out


def redact_code(content: Column, lang: str, policy: Policy) -> Column:
    """Replaces detected string literals; all other text stays as it is.

    Line breaks inside strings and comments are hidden while lines are cut, so a literal of several lines is
    replaced as a whole; it is judged by the line it begins in. Texts without any match are not cut at all.
    """
    cut = F.replace(content, F.lit(_MARK), F.lit(_OWN))
    if lang in NOT_CODE:
        cut = pieces(cut, lang, lambda p: F.replace(p, F.lit("\n"), F.lit(_HIDDEN)))
    out = F.array_join(F.transform(F.split(cut, "\n"), lambda t: _redact_line(t, lang, policy)), "\n")
    shown = F.replace(F.replace(out, F.lit(_HIDDEN), F.lit("\n")), F.lit(_OWN), F.lit(_MARK))
    return F.when(_any_match(content, policy), shown).otherwise(content)


def redact_env(content: Column, policy: Policy) -> Column:
    """key=value files: every value goes, but for blank, comment, passthrough and allowed lines.

    A redacted line loses its indentation and the text its final line break.
    """
    if not set(policy.entity_types) & set(ENV_ACTIVE):
        return content

    def on_line(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+|\s+$", "")
        key = F.rtrim(F.regexp_extract(bare, r"^([^=]*)=", 1))
        value = F.regexp_extract(bare, r"^[^=]*=((?s:.*))$", 1)
        keep = (
            (bare == "")
            | F.startswith(bare, F.lit("#"))
            | ~F.contains(bare, F.lit("="))
            | (F.regexp_replace(value, r"\s+", "") == "")
            | key.isin(*policy.env_passthrough_keys)
            | _allowed(value, policy)
        )
        return F.when(keep, line).otherwise(F.concat(key, F.lit("=[REDACTED:SECRET]")))

    return F.array_join(F.transform(text.lines(content), on_line), "\n")


def redact(content: Column, file: Column, language: Column, policy: Policy) -> Column:
    """What may be sent of a file, a delta or a notice: by file name and language."""
    if not policy.enabled:
        return content
    base = paths.basename(file)
    out = content
    for lang in LITERAL:
        out = F.when(language == lang, redact_code(content, lang, policy)).otherwise(out)
    env = F.startswith(base, F.lit(".env")) | F.endswith(base, F.lit(".env"))
    return F.when(env, redact_env(content, policy)).otherwise(out)


def classify_lines(lines: DataFrame, text_col: str, load: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """Adds ``entity`` from a caller's model, loaded once per task; it finds names and addresses too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(entity=model(batch[text_col].tolist()))

    return lines.mapInPandas(run, T.StructType([*lines.schema.fields, T.StructField("entity", T.StringType())]))


def redact_classified(corpus: DataFrame, lang: str, load: Callable[[], Callable[[list[str]], list[str | None]]], policy: Policy) -> DataFrame:
    """(file, content) with literals redacted where a caller's model finds an active type on their line.

    Lines go through the model in batches over all files and are put together again per file, which
    is at most as large as an indexable file. A literal over several lines is left alone.
    """
    lines = text.unfold(corpus, ["file"], F.split("content", "\n"), "pos", "line")
    judged = classify_lines(lines, "line", load)
    active = F.when(F.col("entity").isin(*policy.entity_types), F.col("entity"))
    out = judged.select("file", "pos", _redact_line(F.col("line"), lang, policy, active).alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return out.groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))
