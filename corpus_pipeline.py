"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept, and is written as Parquet in the shared folder before the next
one reads it, so a lost executor costs at most the stage that runs. All stages but the last return the columns of
`documents`; the last returns token pieces with their sequences and offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.llm import mixing, near_dedup, packing, quality_classifier, substring_dedup
from factledger.llm.common import count_words, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from the labels of all folds but one."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id: ball hashing, completed to all pairs of similarity 0.8."""
    return near_dedup.one_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that also stand elsewhere."""
    cut = substring_dedup.cut(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    mixed = mixing.mix(docs, count_words(F.col("text"))).filter("mix_copies > 0")
    return mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("doc.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and where they go."""
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

#: Fitting, prefix filtering and packing are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
