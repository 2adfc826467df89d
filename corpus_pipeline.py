"""A training-data pipeline of five operators: documents in, token files out.

Each stage works on all rows its predecessor kept, and is written as Parquet and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorespan.llm import decontaminate, mixing, quality, simhash, token_files
from lorespan.llm.common import fresh, stored, table
from lorespan.llm.queries import LEAST_SCORE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of ``labels`` do not reject; a null or empty text is scored like any other."""
    score = fresh(docs, "score")
    scored = quality.with_score(docs, quality.train(docs, table(spark, sf_dir, "labels")), name=score)
    return scored.filter(scored[score] >= LEAST_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    return simhash.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``: hit spans are cut out, mostly hit documents go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and check sum of every document in the token files written of them."""
    return token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).read()


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

# Trees, bit distances, knapsacks and a tokenizer are not SQL; tests/llm holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
