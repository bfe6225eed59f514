"""Corpus cleaning as a chain of operators over ``documents``.

Every stage works on all documents that the one before it kept; its result is
written as Parquet and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import bpe, jaccard, leaks, pii, toxicity
from tagweave.llm.queries import crc_remainder
from tagweave.session import ensure_checkpoint_dir, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    ensure_checkpoint_dir(spark)
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return model.score(docs, out="__toxicity").filter("__toxicity < 0.5").drop("__toxicity")


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a
    similarity of 0.8 or more: the one with the smallest id."""
    ensure_checkpoint_dir(spark)
    return jaccard.keep_first(docs, width=5, percent=80)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ensure_checkpoint_dir(spark)
    return leaks.drop_leaked(docs, leaks.find_leaks(docs, _table(spark, sf_dir, "benchmark")))


def mask_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in the text replaced by the name of their kind."""
    ensure_checkpoint_dir(spark)
    columns = docs.columns
    found = pii.find_identifiers(docs, out="__pii")
    masked = found.withColumn("text", pii.mask(F.col("text"), F.col("__pii")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_similar),
    ("decontamination", drop_leaked),
    ("identifiers", mask_identifiers),
    ("tokens", tokenize),
]

# fitted trees, similarity groups and token ids are beyond SQL; tests compare
# the stages with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
