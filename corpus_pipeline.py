"""From raw documents to token ids: quality, near copies, repeats, benchmark passages, encoding.

Each stage gets what the one before kept and returns the columns of ``documents``; the last
returns ids.  Documents with a null doc_id go through all stages: they can't be told to be
a copy, so only quality and benchmark passages remove them.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm.byte_bpe import round_trip
from shelfwatch.llm.common import table
from shelfwatch.llm.decontaminate import decontaminate
from shelfwatch.llm.jaccard import keep_one
from shelfwatch.llm.quality import score_documents, train
from shelfwatch.llm.substring import remove_repeats
from shelfwatch.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows of its input, predicts to be good."""
    labels = table(spark, folder, "labels")
    model = train(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score_documents(rows, model).filter("predicted = 1").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of every group of near copies."""
    return keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that an earlier document holds."""
    return remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate(docs, table(spark, folder, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids, their digest and the digest of what they decode to."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

# Classifier and encoder can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
