"""Substring dedup: words covered by a window that also starts in an earlier document go.

1. Anchors.  Every window of ``WINDOW`` words has an anchor, the run of ``ANCHOR`` words in it
   with the smallest hash, so equal windows have equal anchors.  Only windows whose anchor
   occurs in two documents go on.
2. Shards.  Their documents are cut into segments, one per run of windows with the same short
   anchor; equal segments collapse to one with the smallest doc_id, so copies cost one
   segment.  Segments are dealt to shards by short anchor.  A short anchor that holds more
   than 1/1000 of all segments (so there are at most 1000) is cut into single windows keyed
   by the words at both ends, which spreads it.
3. Per shard a compressed FM-index (wavelet matrix) is built and every segment streamed
   through it: backward search with matching statistics gives the interval of each window
   and, over the interval, the smallest doc_id.
4. A document loses the words of every window whose smallest doc_id is below its own.

Shards have about ``SHARD_WORDS`` words whatever the corpus.  Words are
``[^\\x20\\x09-\\x0D]+``, unchanged.  Null and empty texts and texts below ``WINDOW`` words lose
nothing; null doc_ids neither lose words nor make others lose any.  Rows that repeat a
doc_id are one document's: they don't make each other lose words.  Windows are judged on
the input.  An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import small, word_numbers
from shelfwatch.llm.fm_index import FmIndex
from shelfwatch.session import cut_lineage

WINDOW = 50
ANCHOR = 25
SHORT_ANCHOR = 5
SHARD_WORDS = 500_000
HOT_SHARE, HOT_LEAST = 1_000, 2_000
SEEN_SEGMENTS = 200_000
PENDING_ROWS, PENDING_BYTES = 10_000, 8 * 2**20  # of segments before a task hands them on
PENDING_ANCHORS = 200_000  # counted by a task before it hands them on
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_numbers().__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    out = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size if len(out) else 0):
        out = (out + h[k:k + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def anchor_runs(h: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each run of windows with one anchor."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(h, size)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1)
    place = views.argmin(axis=1) + np.arange(len(views))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[first]], first, np.concatenate([first[1:], [len(views)]]) - 1


def anchor_places(h: np.ndarray, window: int, size: int) -> tuple[list[int], list[list[int]], list[list[int]]]:
    """Every distinct anchor hash once, with the first and last window starts of all its runs."""
    anchors, first, last = anchor_runs(h, window, size)
    order = np.argsort(anchors, kind="stable")
    distinct, at = np.unique(anchors[order], return_index=True)
    split = lambda starts: [part.tolist() for part in np.split(starts[order], at[1:])] if len(distinct) else []
    return distinct.view(np.int64).tolist(), split(first), split(last)


_PROFILE = pa.schema([
    ("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()),
    ("anchors", pa.list_(pa.int64())), ("first", pa.list_(pa.list_(pa.int32()))), ("last", pa.list_(pa.list_(pa.int32()))),
])
_PROFILE_DDL = "doc_id long, h long, n_words long, sha256 string, anchors array<long>, first array<array<int>>, last array<array<int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), text: a document's decision belongs to (doc_id, h)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def profile(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word count, digest of all words and anchors of every row, an anchor once with all its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = split_words(text)
                anchors, first, last = (
                    anchor_places(word_hashes(words), window, min(ANCHOR, window)) if doc_id is not None and len(words) >= window
                    else ([], [], []))
                rows.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), anchors, first, last))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(_PROFILE)[2:])] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=_PROFILE)

    return _keyed(docs).mapInArrow(run, _PROFILE_DDL)


def _between_documents(runs: DataFrame) -> DataFrame:
    """Anchors that occur in two documents."""
    return runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")


def candidate_windows(profiles: DataFrame) -> DataFrame:
    """doc_id, h, runs: the window starts whose anchor another document holds.

    Text that repeats in itself is one row per anchor with all its runs, not one per repeat.
    """
    runs = profiles.filter(F.size("anchors") > 0).select("doc_id", "h", F.explode(F.arrays_zip("anchors", "first", "last")).alias("r")).select(
        "doc_id", "h", F.col("r.anchors").alias("anchor"), F.col("r.first").alias("first"), F.col("r.last").alias("last"))
    shared = small(cut_lineage(_between_documents(runs)))
    places = F.arrays_zip("first", "last")
    return runs.join(shared, "anchor", "left_semi").groupBy("doc_id", "h").agg(
        F.flatten(F.collect_list(places)).alias("runs"))


def _wanted(h: np.ndarray, runs: list[dict], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short anchor, first and last start of the segments of the wanted windows."""
    keep = np.zeros(len(h) - window + 1, bool)
    for r in runs:
        keep[r["first"]:r["last"] + 1] = True
    anchors, first, last = anchor_runs(h, window, min(SHORT_ANCHOR, window))
    run_of = np.repeat(np.arange(len(first)), last - first + 1)
    edge = np.flatnonzero(np.concatenate([[True], (run_of[1:] != run_of[:-1]) | (keep[1:] != keep[:-1])]))
    stop = np.concatenate([edge[1:], [len(keep)]]) - 1
    some = keep[edge]
    return anchors[run_of[edge[some]]], edge[some], stop[some]


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("segment", pa.binary()), ("words", pa.binary()), ("size", pa.int64()),
                       ("doc_id", pa.int64()), ("h", pa.int64()), ("starts", pa.list_(pa.int64()))])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SEGMENTS)], schema=_SEGMENTS)


def anchor_counts(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """anchor, n of the segments of rows doc_id, h, text, runs: added up in the task, so what its documents share is one row."""
    held: dict[int, int] = {}

    def handed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], names=["anchor", "n"])

    for batch in batches:
        for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            anchors, n = np.unique(_wanted(word_hashes(split_words(text)), runs, window)[0].view(np.int64), return_counts=True)
            for anchor, k in zip(anchors.tolist(), n.tolist()):
                held[anchor] = held.get(anchor, 0) + k
            if len(held) >= PENDING_ANCHORS:
                yield handed_on()
                held.clear()
    if held:
        yield handed_on()


def segments(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """anchor, segment (digest), words (once per task, else null), size, doc_id, h, starts.

    A segment that a document holds many times is one row with all its starts, so text that
    repeats in itself travels once (a document of more than ``PENDING_ROWS`` segments may give it again).

    ``texts``: doc_id, h, text, runs.
    """
    short = min(SHORT_ANCHOR, window)

    per = cut_lineage(texts.mapInArrow(lambda batches: anchor_counts(batches, window), "anchor long, n long").groupBy("anchor").agg(
        F.sum("n").alias("n")))
    total = per.agg(F.sum("n")).first()[0] or 0
    hot = {r["anchor"] for r in per.filter(F.col("n") > max(total // HOT_SHARE, HOT_LEAST)).select("anchor").collect()}

    def cut(doc_id: int, h: int, text: str, runs: list[dict]) -> Iterator[tuple]:
        words = split_words(text)
        hashes = word_hashes(words)
        grams = gram_hashes(hashes, short).view(np.int64)
        for anchor, first, last in zip(*(a.tolist() for a in _parts(hashes, runs, window))):
            # Under a hot anchor every window is on its own, keyed by its two ends.
            one_by_one = ((int(_ends(grams, s, window, short)), s, s) for s in range(first, last + 1))
            for key, a, b in one_by_one if anchor in hot else ((anchor, first, last),):
                yield key, b" ".join(words[a:b + window]), b - a + window, doc_id, h, a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                starts: dict[tuple[int, bytes], list[int]] = {}
                for key, data, size, doc_id, h, start in cut(*row):
                    digest = hashlib.blake2b(data, digest_size=16).digest()
                    if (key, digest) in starts:
                        starts[key, digest].append(start)
                        continue
                    starts[key, digest] = [start]
                    new = digest not in seen
                    if new:
                        if len(seen) >= SEEN_SEGMENTS:
                            seen.clear()
                        seen.add(digest)
                        held += len(data)
                    rows.append((key, digest, data if new else None, size, doc_id, h, starts[key, digest]))
                    if len(rows) >= PENDING_ROWS or held >= PENDING_BYTES:
                        yield _as_batch(rows)
                        rows, held = [], 0
                        starts.clear()
        if rows:
            yield _as_batch(rows)

    return texts.mapInArrow(run, "anchor long, segment binary, words binary, size long, doc_id long, h long, starts array<long>")


def _parts(hashes: np.ndarray, runs: list[dict], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchors, first, last = _wanted(hashes, runs, window)
    return anchors.view(np.int64), first, last


def _ends(grams: np.ndarray, start: int, window: int, short: int) -> np.int64:
    return np.bitwise_xor(grams[start], np.left_shift(grams[start + window - short], 1))


def shard_statistics(contents: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """segment, anchor, first, last, smallest: runs of windows of a segment with one smallest doc_id."""
    number: dict[bytes, int] = {}
    sequences = [np.fromiter((number.setdefault(w, len(number) + 1) for w in data.split(b" ")), np.int64)
                 for data in contents["words"]]
    index = FmIndex(sequences)
    owner = np.repeat(contents["doc_id"].to_numpy(np.int64), np.diff(index.starts))
    sequence, offset, low, high = index.matching_statistics(window)
    # Intervals of equal windows are equal and others don't overlap, so each is summed up once.
    lows, which = np.unique(low, return_inverse=True)
    ends = np.zeros(len(lows), np.int64)
    ends[which] = high
    bounds = np.column_stack([lows, ends]).ravel()
    held = np.concatenate([owner[index.suffixes], [np.iinfo(np.int64).max]])
    smallest = np.minimum.reduceat(held, bounds)[::2][which] if len(bounds) else np.zeros(0, np.int64)
    order = np.lexsort([offset, sequence])
    sequence, offset, smallest = sequence[order], offset[order], smallest[order]
    edge = np.flatnonzero(np.concatenate([[True], (sequence[1:] != sequence[:-1]) | (smallest[1:] != smallest[:-1])])) if len(order) else order
    stop = np.concatenate([edge[1:], [len(order)]]) - 1 if len(order) else order
    return pd.DataFrame({
        "anchor": contents["anchor"].to_numpy()[sequence[edge]], "segment": contents["segment"].to_numpy()[sequence[edge]],
        "first": offset[edge], "last": offset[stop], "smallest": smallest[edge]})


def repeated_spans(docs: DataFrame, profiles: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, h, spans (first, last word): what each document loses."""
    wanted = cut_lineage(candidate_windows(profiles))
    texts = _keyed(docs).join(small(wanted.select("doc_id", "h")), ["doc_id", "h"], "left_semi").join(wanted, ["doc_id", "h"])
    found = cut_lineage(segments(texts.select("doc_id", "h", "text", "runs"), window))
    contents = found.groupBy("anchor", "segment").agg(
        F.max("words").alias("words"), F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    total = found.filter("words is not null").agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    sharded = contents.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    # Built shard by shard: rows of a shard meet in one task, and a shard's size is fixed.
    statistics = sharded.groupBy("shard").applyInPandas(
        lambda group: shard_statistics(group.sort_values(["anchor", "segment"], kind="stable").reset_index(drop=True), window),
        "anchor long, segment binary, first long, last long, smallest long")
    lost = found.select("anchor", "segment", "doc_id", "h", "starts").join(cut_lineage(statistics), ["anchor", "segment"]).filter(
        "smallest < doc_id")
    spans = F.transform("starts", lambda s: F.struct(
        (s + F.col("first")).alias("first"), (s + F.col("last") + window - 1).alias("last")))
    return lost.select("doc_id", "h", spans.alias("spans")).groupBy("doc_id", "h").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def keep_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    gone = np.zeros(len(words), bool)
    for s in spans:
        gone[s["first"]:s["last"] + 1] = True
    return [w for w, g in zip(words, gone) if not g]


def _cut(texts: DataFrame) -> DataFrame:
    """doc_id, h, n_removed, kept, sha256 of rows doc_id, h, text, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = split_words(text)
                rest = keep_words(words, spans)
                removed.append(len(words) - len(rest))
                kept.append(b" ".join(rest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc_id", "h", "n_removed", "kept", "sha256"])

    return texts.mapInArrow(run, "doc_id long, h long, n_removed long, kept string, sha256 string")


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    profiles = cut_lineage(profile(docs, window))
    spans = cut_lineage(repeated_spans(docs, profiles, window))
    keys = small(spans.select("doc_id", "h"))
    texts = _keyed(docs).join(keys, ["doc_id", "h"], "left_semi").join(spans, ["doc_id", "h"])
    cut = _cut(texts.select("doc_id", "h", "text", "spans")).select(
        "doc_id", "h", "n_removed", F.col("sha256").alias("kept_sha256")).dropDuplicates(["doc_id", "h"])
    return profiles.select("doc_id", "h", "n_words", "sha256").join(cut, ["doc_id", "h"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their columns; texts that lose words keep the others, joined by one space.

    ``n_chars`` follows the text where the table has it.  Texts that lose nothing stay as they are.
    """
    profiles = cut_lineage(profile(docs, window))
    spans = cut_lineage(repeated_spans(docs, profiles, window))
    keys = small(spans.select("doc_id", "h"))
    # The row travels as one struct, so no column of it can clash with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    untouched = rows.join(keys, ["doc_id", "h"], "left_anti").select("row")
    touched = rows.join(keys, ["doc_id", "h"], "left_semi")
    texts = touched.select("doc_id", "h", F.col("row.text").alias("text")).join(spans, ["doc_id", "h"])
    kept = _cut(texts.select("doc_id", "h", "text", "spans")).select("doc_id", "h", "kept").dropDuplicates(["doc_id", "h"])
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return untouched.unionByName(touched.join(kept, ["doc_id", "h"]).select(row.alias("row"))).select("row.*")
