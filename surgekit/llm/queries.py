"""The queries of the training-data operators. Each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, decontaminate, embedding_dedup, merkle_manifest, ngram_join, oracles, periodic_runs, quality_pu, sharding,
               suffix_dedup, token_codes, token_counts, toxicity, url_filter)
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


#: The queries' tokenizer files, the end id of op1 and the separator of op4 (<|endoftext|>).
BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID, SEPARATOR_ID = 2, 50256

#: The query's rules as (host, path, verdict); the longest rule that fits wins.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of directly addressable codes of all documents, read back."""
    return token_codes.read_back(token_codes.write_codes(table(spark, sf_dir, "documents"), BPE_JSON, END_ID))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold within the edit budget."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all page urls: by rule, else by boosted trees trained on the urls that the rules label."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by a separator scan over flat token files."""
    return token_counts.document_counts(table(spark, sf_dir, "documents"), BPE_JSON, SEPARATOR_ID)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingle sets link at a Jaccard similarity of 0.9 or more."""
    return ngram_join.document_components(table(spark, sf_dir, "documents"), 3, 90, 100)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause-grammar toxicity scores of all documents."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated 200-byte strings, removed from all documents."""
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their links at cosine 0.95 or more, found by lattice hashing."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by ranked byte merges, and the bytes they decode to."""
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digest(docs, byte_bpe.make_encoder(docs, BPE_RANKS, public_tokenizers.PATTERN))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative positive-unlabelled quality scores of all documents."""
    return quality_pu.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and (where tampered with, wrong) root, climbed by a recursive query."""
    return merkle_manifest.verify(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, copies of a text together."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, a tenth of which get a periodic tail, and the texts without the repeats."""
    return periodic_runs.run_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_codes, op2_decontaminate, op3_url_filter, op4_token_counts, op5_ngram_join, op6_toxicity, op7_suffix_dedup,
    op8_embedding_dedup, op9_byte_bpe, op10_quality_classifier, op11_merkle_manifest, op12_sharding, op13_periodic_runs,
)}

ORACLES: dict[str, str] = {"op5_ngram_join": oracles.OP5, "op8_embedding_dedup": oracles.OP8, "op11_merkle_manifest": oracles.OP11,
                          "op13_periodic_runs": oracles.OP13}
