"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, as the next one's docs; the last
gives token ids. Stages work on all that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitempo.llm import decontaminate, langid, nearcopies, pieces, pii
from bitempo.llm.common import keep, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that are learned from the labelled ones.

    Those with a null, empty or letterless text go; repeated rows stay; a tie goes to the first language by name.
    """
    return langid.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles, the one of the smallest doc_id.

    Of repeated rows of a doc_id one stays; documents without words and rows without doc_id all stay.
    """
    return nearcopies.distinct(docs, k=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; null and empty texts stay as they are."""
    return pii.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to; a null or empty text has the end id alone."""
    encoded = pieces.encode(docs)
    return encoded.select("doc_id", "n_tokens", F.split("ids", " ").cast("array<int>").alias("ids"), F.col("decoded").alias("text"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]
#: SQL has no word for these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
