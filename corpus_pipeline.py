"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capledger.llm import _common as C
from capledger.llm import exact_dedup, jaccard_join, mixing, packing, quality_classifier

#: Words of a shingle of the near-copy stage, and the similarity from which two documents are copies, in per cent.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to docs without labels, rejects go; odd rows as in drop_low_quality."""
    return quality_classifier.drop_low_quality(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays; odd rows as in drop_copies."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of the n-gram Jaccard join connect, the one with the smallest id stays.

    Shingles are of NEAR_WORDS words; op6's own query has the three words and 90 % of its contract.
    Odd rows as in jaccard_join.drop_near_copies.
    """
    return jaccard_join.drop_near_copies(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; those that it does not take, or without words, go; odd rows as in apply_mix."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, in sequences of at most 4096 tokens; odd rows as in packing.pack."""
    return packing.pack(docs)


STAGES = [("quality classifier", classify), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", drop_near_copies), ("mixing", mix), ("packing", pack)]
#: SQL cannot express the learned classifier or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are a table in the shared folder.

    Null texts, null and repeated ids, repeated rows and extra columns are carried through as each stage tells; an empty table
    gives no piece.
    """
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
