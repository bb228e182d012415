"""A training corpus from ``documents`` in five stages; each stage's rows are written and read again by the next.

Null texts count as empty ones and stay null until they are packed; null ids stay
null. Rows that repeat an id are judged by their own texts, but for near
duplicates, where they go together. Ties go to the smaller id. An empty table
passes through every stage, and columns beside ``text`` and ``n_chars`` stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurion.llm import exact_dedup, minhash_dedup, packing, quality, secret_scan
from tellurion.llm.common import land, run_dir, scratch, ship, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.keep_first(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 0.8 alike or more."""
    ship(spark)
    return minhash_dedup.keep_one(docs, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced, and their new numbers of characters."""
    ship(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, placed in sequences."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good), ("exact dedup", distinct), ("minhash near-dedup", unlike), ("secret scans", clean), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), run_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        # Once a stage's rows are written, the tables that it made on the way can go.
        with scratch(spark):
            docs = land(stage(spark, docs, sf_dir), f"{path}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier's and the packing's results can't be had from SQL; tests hold each stage against brute force.
ORACLE_SQL = None
