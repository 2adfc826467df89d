"""Column functions on file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the language each one is indexed as.
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "javascript",
    ".tsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".go": "go",
    ".rs": "rust",
}


def basename(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def parent_dir(file: Column) -> Column:
    return F.when(F.instr(file, "/") == 0, F.lit(".")).otherwise(
        F.regexp_replace(file, "/[^/]*$", "")
    )


def module_of(file: Column) -> Column:
    """First path segment, or '.' for a file at the root."""
    return F.when(F.instr(file, "/") > 0, F.substring_index(file, "/", 1)).otherwise(F.lit("."))


def extension(file: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot does not start one."""
    return F.lower(F.regexp_extract(basename(file), r"[^.].*?(\.[^.]*)$", 1))


def language_of(file: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    return F.try_element_at(table, extension(file))


def in_ignored_dir(file: Column, names) -> Column:
    """True when a directory of the path starts with '.' or has an ignored name."""
    alternatives = "|".join([r"\.[^/]*", *(re.escape(n) for n in sorted(names))])
    return F.rlike(file, F.lit(f"(?:^|/)(?:{alternatives})/"))


def is_test_file(file: Column, language: Column) -> Column:
    base = basename(file)
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    return (
        F.when(language == "python", F.startswith(base, F.lit("test_")) | F.endswith(base, F.lit("_test.py")))
        .when(
            language == "javascript",
            F.contains(base, F.lit(".test."))
            | F.contains(base, F.lit(".spec."))
            | F.rlike(path, F.lit("(?:^|/)__tests__(?:/|$)")),
        )
        .when(language == "go", F.endswith(base, F.lit("_test.go")))
        .when(language == "rust", F.rlike(path, F.lit("(?:^|/)tests(?:/|$)")))
        .otherwise(F.lit(False))
    )
