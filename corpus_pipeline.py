"""A corpus pipeline of five stages. Each reads what the one before has written and works on all of it.

1. Documents whose language is not recognised go.
2. Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one document stays.
3. Personal data is masked in the text.
4. Sources are mixed to target weights: documents repeat, are cut or go as their source's share asks.
5. Texts are encoded to ids, and decoded to see that nothing is lost.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import language, mixing, pieces, pii, simhash
from metricloom.llm.queries import piece_model
from metricloom.session import checkpoint_dir


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.mask(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.take(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces.encode(docs, piece_model(), check="round_trip", keep_text=False)
    return found.select("doc_id", "source", "lang", F.size("ids").alias("n_ids"), "ids", "round_trip")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


STAGES = [
    ("language ID", recognised),
    ("SimHash near-dedup", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources", mixed),
    ("SentencePiece", encoded),
]

#: Trained models, hashes and merges are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
