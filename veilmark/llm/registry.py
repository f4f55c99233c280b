"""The training-data queries by name, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm import (
    bpe_codec,
    fingerprint_index,
    jaccard_join,
    language_id,
    license_scan,
    merkle_manifest,
    mixture,
    oracles,
    pivot_index,
    prefix_trie,
    secret_scan,
    stream_dedup,
    suffix_dedup,
    toxicity,
    tree_oracles,
)
from veilmark.sources import reading

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; a small one is spread over all cores."""
    return reading.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": lambda spark, sf: secret_scan.report(_documents(spark, sf)),
    "op2_mixture": lambda spark, sf: mixture.report(_documents(spark, sf)),
    "op3_language_id": lambda spark, sf: language_id.report(_documents(spark, sf)),
    "op4_suffix_dedup": lambda spark, sf: suffix_dedup.report(_documents(spark, sf)),
    "op5_pivot_index": lambda spark, sf: pivot_index.report(spark.read.parquet(f"{sf}/embeddings.parquet")),
    "op6_bpe": lambda spark, sf: bpe_codec.report(_documents(spark, sf)),
    "op7_license_scan": lambda spark, sf: license_scan.report(_documents(spark, sf)),
    "op8_jaccard_join": lambda spark, sf: jaccard_join.report(_documents(spark, sf)),
    "op9_fingerprint_index": lambda spark, sf: fingerprint_index.report(_documents(spark, sf)),
    "op10_exact_dedup": lambda spark, sf: stream_dedup.report(spark.read.parquet(f"{sf}/documents.parquet")),
    "op11_merkle_manifest": lambda spark, sf: merkle_manifest.report(_documents(spark, sf)),
    "op12_toxicity": lambda spark, sf: toxicity.report(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
    "op13_prefix_trie": lambda spark, sf: prefix_trie.report(spark.read.parquet(f"{sf}/conversations.parquet")),
}

#: Of the others, SQL can express neither a trained model, nor the encoder, nor the seeded mixture.
ORACLES: dict[str, str] = oracles.ORACLES | tree_oracles.ORACLES
