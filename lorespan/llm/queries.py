"""The operators bound to the given tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm import decontaminate, html_text, licenses, mixing, packing, prefix_trie, privacy, quality, secrets, simhash, structure_repair, token_files, topk
from lorespan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Pieces of text that a worker remembers where no other stage needs its memory.
PIECES = 400_000
#: Documents with a lower score are taken for bad ones.
LEAST_SCORE = 0.3


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as flat files in the order of doc_id and read back from them."""
    return token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), remembered=PIECES).read()


@query("op5_source_mixing")
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix to target weights takes of every document."""
    return mixing.mixed_rows(table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by sparse rules learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = quality.with_score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


@query("op10_simhash_near_duplicates")
def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), name="found").select("doc_id", "found.*")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; each source is an owner, each document a repository."""
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and terms that disclose it."""
    return privacy.report(table(spark, sf_dir, "documents"))


@query("op8_cover_tree_top_k")
def op8_cover_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of the highest inner product for every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversation prefixes, each conversation rebuilt with the head of its base."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_structure_repair")
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after damage."""
    return structure_repair.repair(table(spark, sf_dir, "conversations"))


@query("op12_lexical_packing")
def op12_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed beside lexically near ones into sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
