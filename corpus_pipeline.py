"""A corpus pipeline over `documents`: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import bpe, langid, minhash, mixing, quality
from quillspan.llm.common import stored
from quillspan.llm.tokenizer_files import tokenizer_json

#: Near duplicates: five words and a similarity of 0.8.
SHINGLE_WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null texts too), or mostly of n-grams that no language has, go; an empty table stays empty."""
    return langid.language_stage(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 go; a null text is scored as an empty one, an empty table stays empty."""
    return quality.quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, a row of the least doc_id stays; rows that only share a doc_id stay both, as do all without words or with a null doc_id."""
    return minhash.without_near_duplicates(docs, size=SHINGLE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat as the mix repeats them. A null source is a source, rows without words are not taken."""
    return mixing.mixed_rows(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; a null text has none, an empty table gives no rows."""
    return bpe.round_trip(docs, tokenizer_json())


STAGES = [("language_id", language_id), ("quality_classifier", quality_classifier), ("minhash_near_dedup", minhash_near_dedup), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: Filters, hash minima and merges are not SQL; the stages are tested against brute force and the library in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
