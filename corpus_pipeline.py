"""From documents to packed training sequences: each stage is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import lines, mixing, packing, quality, similarity
from maskwright.llm.common import DOC_COLUMNS, documents, shipped, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return quality.kept_documents(docs.select(*DOC_COLUMNS), shipped(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one; documents that lose all their lines go."""
    shipped(spark)
    return lines.deduplicated_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    shipped(spark)
    return similarity.one_of_each_class(docs.select(*DOC_COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source in part."""
    shipped(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    shipped(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("packing", pack),
]

#: The stages can't be put in SQL (exact binomial bounds, tokenizer, bins); tests hold them against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
