"""From raw documents to packed sequences: reject bad documents, drop exact and near copies, mix the sources, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrier.llm.common import drop_written, read_table, written
from terrier.llm.exact_dedup import drop_copies
from terrier.llm.mixing import mix
from terrier.llm.near_copies import drop_near_copies
from terrier.llm.packing import pack
from terrier.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer doesn't reject."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest id: operator 8's balls of fingerprints come first, each link verified, then bands."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in the sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The stages train a scorer, follow links between near copies and use a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next one; what a stage has read is deleted when it is done."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = written(stage(spark, docs, sf_dir), name)
        if i:
            drop_written(spark, docs)
        docs = done
    return docs
