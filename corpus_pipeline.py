"""A corpus pipeline: what quality keeps, without copies and near copies, mixed to target weights and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it back for the next one. All but the last return the columns of documents, whatever others there are and however
they are named. Empty tables go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauselake.llm import bpe, exact_dedup, minhash, mixing, neighbours
from clauselake.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote does not reject; it learns from the labels outside the held-out fold. A null text
    is judged as an empty one, and rows with equal texts share their fate; without labels all stay."""
    return neighbours.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest id; null ids come last, null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, similarity 0.8) the document with the smallest id, null ids last;
    texts without words stay."""
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, a text without words has size
    0 and goes with its source's others."""
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, and digests of its ids and of what they decode to; a null text has none."""
    return bpe.query(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: SQL cannot express the neighbour vote or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
