"""The training-data pipeline: stages over ``documents``, each written and read again.

Quality filter, near-duplicate removal, redaction of personal data, mixing and packing. All
stages but the last return the columns of ``documents``. The quality network is learned from
``labels``; every stage looks at all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcell.llm import byte_cnn
from quillcell.llm.catalog import fold, tokenizer
from quillcell.llm.mixing import mix, training_order
from quillcell.llm.near_dup import NearDup, without_copies
from quillcell.llm.packing import pack
from quillcell.llm.pii import redacted
from quillcell.session import written

#: Documents below this probability of good quality go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the byte network rejects; learned from the labels of the training folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(5) != 0).select("doc_id", F.col("quality").alias("y"))
    network = byte_cnn.learn(docs, labels)
    scored = byte_cnn.scored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string")), network)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies: five words, 0.8."""
    return without_copies(docs, NearDup())


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and orders whole documents by the curriculum; one row per copy."""
    return training_order(mix(docs, whole=True, with_text=True), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 tokens, in training order."""
    return pack(docs, tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return docs
