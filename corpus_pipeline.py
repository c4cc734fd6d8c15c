"""From raw documents to packed sequences: each stage reads what the one before has written.

Every stage takes all rows that its predecessor kept, whole. The first four
return the columns of `documents`; the last returns the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from matchday.llm import common, jaccard_join, mixing, packing, quality, suffix_dedup
from matchday.session import shared_dir
from matchday.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the factorisation machine scores below its threshold."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, "_quality_score")
    return scored.filter(F.col("_quality_score") >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the least id."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages of 200 bytes or more that an earlier document (or place) has; `n_chars` follows the text."""
    out = suffix_dedup.remove_repeats(docs, keep="first")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the domains' token shares meet the targets."""
    return mixing.resample(docs, read_table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in full windows."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", target_weights),
    ("packing", packed),
]

# Similarity, suffix arrays, the classifiers and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
