"""Small tables with the odd rows that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, size string, row string, fp string, hits string, stats string"
WORDS = "the of and to a in is on that it was for cat dog house river stone light".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) * (rng.random() < 0.6) for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``(doc_id, text, source)`` with further columns whose names operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), "k", "s", "z", "r", "f", "h", "x") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    long_text = sentence(rng, 60_000)
    plain = [(n, sentence(rng, rng.randrange(1, 60)), f"s{n % 4}") for n in range(40)]
    return [
        *plain, (100, None, "s0"), (101, "", "s1"), (102, " \n\t ", None), (None, "a text without id", "s2"), (None, None, None),
        (103, long_text, "s0"), (104, long_text, "s1"), (5, plain[5][1], "s1"), (5, plain[5][1], "s1"), (7, "another text of 7", "s3"),
    ]


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, []).limit(0)


def as_tuples(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
