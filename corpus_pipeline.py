"""A training corpus from documents: good ones, one of each group of copies, mixed to target weights, encoded.

Every stage judges rows, not ids: rows that repeat an id, or have none, go through each on their own. Texts of any length are
read whole, extra columns are kept up to the last stage, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmill.llm import bpe, exact_dedup, minhash, mixing, quality
from spanmill.session import cut, table

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source; null texts go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the smallest id, rows without an id last; null counts as empty."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id, rows without an id last; rows without words stay."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null sources are one source, ties and repeated rows are told apart by number."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document; null counts as empty."""
    return bpe.encode_documents(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix_sources", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage hands on is kept in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
