"""A corpus pipeline over documents: toxicity, SimHash near-duplicates, mixing to target weights, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. Null and empty texts are documents without words:
not toxic unless the bias says so, copies of each other, of size 0 in the mix, without pieces. Rows may repeat or lack an
id or a source; an empty table stays empty; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.mixing import mixed_rows
from tessera.llm.nearcopies import near_copy_dedup
from tessera.llm.toxicity import remove_toxic
from tessera.llm.unigram import sentencepiece_digest
from tessera.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): that of the smallest id."""
    return near_copy_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document with their digests, and its source where there is one."""
    return sentencepiece_digest(docs, keep_ids=True, also=[c for c in ("source",) if c in docs.columns])


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: A trained classifier, XXH64 majority bits and Viterbi have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each over the Parquet table that the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
