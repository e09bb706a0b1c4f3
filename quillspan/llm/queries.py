"""The numbered operators as queries of the driver's tables, and their SQL. Each query reads its whole table and derives the digest columns; odd rows are as in the operator it calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embed_dedup, fingerprints, kmeans, langid, merkle, minhash, mixing, quality, sharding, substring, token_binary, token_count
from .tokenizer_files import tokenizer_json


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by law `key`; nulls, repeated ids and an empty table as in sharding.shard."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by cosine of 0.95 or more; odd vectors and repeated ids as in embed_dedup.near_vectors."""
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; a null text counts as empty, a text of any length is cut into pieces of whole words."""
    return token_count.token_counts(_table(spark, sf_dir, "documents"), tokenizer_json(name="word_bpe_49k.json"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, written to files and read back; a null text leaves the end id alone."""
    return token_binary.ids_digest(_table(spark, sf_dir, "documents"), tokenizer_json())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text; a null text counts as empty, rows of one id are scored each on its own."""
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a similarity of 0.8 of their 4-word shingles; odd rows as in minhash.near_duplicates."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; a null text counts as empty, repeated rows are told each."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_json())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every whole text; `und` for null texts and those without a letter."""
    return langid.language_digest(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the mix takes of every document; nulls, ties and repeated rows as in mixing.plan."""
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text; an empty table gives no rows, odd rows as in fingerprints.fingerprints."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound vectors of 64 components in 16 clusters after 3 rounds; odd vectors as in kmeans.cluster_digest."""
    return kmeans.cluster_digest(_table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all whole texts that windows of 35 words repeat; odd rows as in substring.without_repeats."""
    return substring.repeats_digest(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf, path and check for every document; nulls, ties and repeated rows as in merkle.manifest."""
    return merkle.manifest_digest(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_token_ids": op4_token_ids,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}

#: Only what SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op9_mixing": mixing.MIX_SQL, "op11_centroid_clustering": kmeans.CLUSTER_SQL, "op12_substring_dedup": substring.REPEATS_SQL, "op13_merkle_manifest": merkle.MANIFEST_SQL}
