"""Corpus pipeline: documents to token ids in five stages.

Each stage is ``(name, function)``; the function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

quality   documents that the classifier rejects go (operator 10)
lines     repeated lines go, and documents left without words (operator 3)
near      of each group of near duplicates one document stays (operator 5:
          word 5-grams, Jaccard 0.8 or more)
mix       rows repeat or go so that the sources reach their target weights (operator 9)
tokens    every document's token ids (operator 7)

Nulls, empty and very long texts, repeated rows and empty tables pass as the operators'
docstrings say: a null or blank text is rejected by the first stage; a null id
is kept like any other; repeated rows survive together until ``near``, which
keeps all rows of the smallest id of a group.  Columns besides the text and
``n_chars`` stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalam.llm import bpe_prefix, line_dedup, mixing, ngram_join, quality
from qalam.llm.common import documents, materialize, ship_package


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_deduplicated(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    encoded = bpe_prefix.encode_documents(docs)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near", drop_near), ("mix", mix_sources),
          ("tokens", to_tokens)]

#: The classifier, the permuted mixture and the encoder are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written into the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
