"""Documents to training sequences in five stages, each written and read again.

Every stage works on all rows that the one before has kept and returns the columns of
``documents``; the last returns the pieces of the documents in their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netweave import scratch
from netweave.llm import exact_dedup, mixing, near_dup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rules reject, and without the lines above the limits in the others. Null and empty texts have no words and go; other columns stay; an empty table stays empty."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: the one with the most code points, then the smallest id (null last), then the first in its file. Null counts as empty."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest id (null last), then the first in its file. Texts without words are copies of none and all stay."""
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none beyond its cap, so rows may repeat; null is a source of its own; nulls, empty texts and empty tables as in ``mixing.mix``."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, repeated rows as often as they come; texts of any length are cut into pieces."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL expresses neither the MinHash forest's groups nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = scratch.materialize(docs, f"stage{n + 1}")
    return docs
