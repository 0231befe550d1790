"""Registered queries of the corpus operators: name -> (spark, folder) -> DataFrame, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm import sql
from shelfwatch.llm.byte_bpe import round_trip
from shelfwatch.llm.common import table
from shelfwatch.llm.decontaminate import overlaps
from shelfwatch.llm.filter_audit import filter_audit
from shelfwatch.llm.hnsw import near_duplicates as vector_duplicates
from shelfwatch.llm.jaccard import near_duplicates
from shelfwatch.llm.packing import pack_documents
from shelfwatch.llm.quality import held_out, score_documents, train
from shelfwatch.llm.spelling import spelling_variants
from shelfwatch.llm.substring import removal_report
from shelfwatch.llm.token_counts import token_counts
from shelfwatch.llm.token_files import read_token_files, write_token_files
from shelfwatch.llm.url_rules import Rule, judge, link_edges
from shelfwatch.llm.warc import normalise_archives, plan_records, read_archives, write_archives
from shelfwatch.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(sql.QUERIES)


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


@register
def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    written = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, scratch_path(spark, "tokens"))
    return read_token_files(written, with_ids=False)


@register
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    streams, members = scratch_path(spark, "warc"), scratch_path(spark, "warc")
    written = write_archives(plan_records(pages), streams)
    archives = normalise_archives(spark, written, streams, members)
    return read_archives(archives, members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Rules that the url query judges by: fixed values.
URL_RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


@register
def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return judge(pages, link_edges(pages), URL_RULES)


@register
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@register
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register
def op3_embedding_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vector_duplicates(table(spark, folder, "embeddings"))


@register
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return removal_report(table(spark, folder, "documents"))


@register
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)


@register
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))
