"""The corpus pipeline: language filter, near-duplicates, mixture, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from duskveil.llm import bpe, common, langid, mixing, simhash

#: SQL cannot express the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; it learns from the labelled ones.

    Null text, empty text and text without letters have no language and go. Repeated rows are judged alike. Without labels
    no language is known and all rows go; an empty table stays empty. Very long texts are read whole.
    """
    return langid.accepted(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8.

    The smallest doc_id of a class stays, of repeated rows one; rows without doc_id stay, as nothing tells which of them
    should. Texts without words are one class. A text of fewer than five words is one shingle. An empty table stays empty.
    """
    return simhash.deduplicated(docs, k=5, least=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring quality domains to their target shares: each row as often as its copies say.

    Null and empty texts have no tokens and the rate of the classifier's bias; repeated rows get equal rates and draws; rows
    without doc_id draw by their text. Without labels all rows keep a rate of about one share of good text. An empty table
    stays empty.
    """
    model = mixing.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    members = common.stored(mixing.memberships(docs, model), "memberships")
    return mixing.mixed(docs, model, mixing.fit(members))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, as digests. Null text has no ids; repeated rows each get their row."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encoded_digests(docs, path)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
