"""From raw documents to token ids: five stages, each on all that its predecessor kept.

Every stage takes nulls in any column, repeated rows, texts of any length and further columns of any name, which it
passes on; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sonolith.llm import bpe, common, exact, mixing, nearjoin, quality
from sonolith.session import scratch_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Null and empty texts fail; repeated rows get equal verdicts."""
    return quality.filter_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest doc_id, null ids last, one row of repeated ones.

    Null texts equal empty ones.
    """
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 on five-word shingles connect, chosen as by exact_dedup.

    Documents without words are linked with none and stay; of rows without a doc_id one of each set of shingles stays,
    unless the set is that of a row with an id.
    """
    return nearjoin.drop_near_duplicates(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null sources are one source; texts without words have size 0."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, repeats included. A null or empty text has no ids."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: No SQL has the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again; what a stage wrote besides its result goes
    when it is done, and its input when its result is there."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark) as keep:
            made = keep(common.materialize(stage(spark, docs, sf_dir), name))
        common.discard(docs)
        docs = made
    return docs
