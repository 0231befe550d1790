"""Token counts per document by a two-tier map-side lookup.

Text is cut into pre-tokens, the pieces between which no merge of the tokenizer can
reach.  Tier one is a broadcast table of frequent pre-tokens and their token counts;
tier two is a bounded cache in each Python worker, filled by the tokenizer itself.
Nothing is shuffled but the bounded sample that tier one is taken from; what is or is
not in that table changes the speed, never a count.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows and ids stay repeated.  An
empty table gives an empty result.  Other columns of the input are ignored.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import Memo, hash_sample, worker_state

SAMPLE_DOCS = 1_000
FREQUENT = 50_000
LIMIT = 4_096
RUNS = re.compile(" *[^ ]+| +")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def cuts_at_spaces(path: str) -> bool:
    """Whether no piece holds a space mark after another character.

    Then no merge crosses from a word into the space before the next word, and a text
    may be cut there without changing a token.
    """
    sp = model(path)
    pieces = (sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    return not any("▁" in p for p in pieces)


def pre_tokens(text: str) -> list[str]:
    """Words, each with the spaces before it less one (the tokenizer puts one before any text)."""
    if not text:
        return []
    text = text.replace("▁", " ")  # the tokenizer writes a space as this very character
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in RUNS.findall(" " + text)]


def _worker_cache(path: str) -> Memo:
    encode = model(path).encode
    # A lone space mark is a run of spaces that ends the text: the text " " less its first space.
    return worker_state("token_counts", path, lambda: Memo(lambda word: len(encode(word)) if word else 1))


def count_tokens(text: str, frequent: dict[str, int], path: str) -> int:
    """Tokens of one text: tier one first, the worker cache for the rest."""
    words = pre_tokens(text)
    found = list(map(frequent.get, words))
    if None in found:
        cache = _worker_cache(path)
        return sum(n if n is not None else cache[w] for w, n in zip(words, found))
    return sum(found)


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, size: int = FREQUENT) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample: tier one.

    The sample is the ``sample`` documents of smallest id hash; the table has at most
    ``size`` entries of pre-tokens up to 64 characters, so the broadcast is bounded.
    """

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(pre_tokens(text or ""))
                if len(seen) > 20 * size:
                    seen = Counter(dict(seen.most_common(10 * size)))
        words = [w for w, _ in seen.most_common(size) if len(w) <= 64]
        cache = _worker_cache(path)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([cache[w] for w in words], pa.int64())], names=["word", "n"])

    few = hash_sample(docs, "doc_id", sample).select("text").coalesce(1)
    return {r["word"]: r["n"] for r in few.mapInArrow(top, "word string, n long").orderBy(F.desc("n")).limit(size).collect()}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, sample: int = SAMPLE_DOCS,
                 size: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; map-only."""
    spark = docs.sparkSession
    if not cuts_at_spaces(path):
        raise ValueError("this model merges across spaces; it can't be counted word by word")
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, path, sample, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            n = [count_tokens(t or "", table, path) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
