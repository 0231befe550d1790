"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

1. Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of whole texts, A-Z in lower case, with one code
   point lost where a checksum of document and word says so (``lose_letter``).  Occurrences
   are counted per task before they are shuffled.  The vocabulary keeps words of at least
   ``LETTERS`` code points and ``LEAST`` occurrences.
2. For every length of word a blocked Bloom filter (one 64-bit block per word looked up, four
   bits) is built by blocks on the executors and broadcast.  All filters together hold
   ``FILTER_BYTES`` at most: a vocabulary too large for that is probed in several passes, each
   against the words of one residue of the hash, so nothing broadcast grows with the data.
3. Every word generates its edits: all deletions, and all replacements by a later letter of
   the alphabet in use (an insertion is the deletion of the other word, an earlier letter
   the other word's later one).  Edits are never spelt out: a word's hash is a polynomial,
   so an edit's hash is a sum away.  Edits are probed against the filter of their length.
4. Only positives are shuffled, as (hash of the edit, hash of the word, place, letter), to an
   exact join with the vocabulary; the edit is then spelt out and compared, so neither a
   false positive nor a clash of hashes leaves a pair.

Null texts hold no words; a null doc_id is the empty string in the checksum.  Repeated rows
count each.  Very long texts are read whole; words of any length are edited like others, a
block of places at a time, and travel once per pass, not once per edit.  Equal counts among
near words are settled by code-point order.  A word without near words has ``n_near`` 0, a null
form and itself as root.  An empty table gives no words.  Other columns, whatever their
names, are ignored.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.session import cut_lineage

LETTERS = 7
LEAST = 2
TIMES = 10
LOSES = 31
BITS_PER_WORD = 24
FILTER_BYTES = 64 * 2**20
LONGEST_SHARD = 64
SEGMENT = 4_096  # blocks of a filter that one group builds
PROBED_WORDS = 16_384  # words a task edits, about
_PENDING_WORDS, _PENDING_BYTES = 200_000, 16 * 2**20
_BLOCK = 1 << 18  # letters edited at a time

# Latin-1 code -> itself as a letter (A-Z lower), everything else a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Runs of letters, A-Z in lower case, as Latin-1."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def lose_letter(run: bytes, prefix: int) -> bytes:
    """The run less one letter if ``LOSES`` divides its checksum; ``prefix`` is that of "<doc_id>:"."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % LOSES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word, n: partial counts of words with at least ``letters`` code points, combined per task."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def emit(seen: Counter) -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for at in range(0, len(words), 20_000):
            some = words[at:at + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in some]), pa.array([seen[w] for w in some], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run_, n in Counter(r for r in runs(text or "") if len(r) >= letters).items():
                    word = lose_letter(run_, prefix)
                    if len(word) >= letters:
                        if word not in seen:
                            held += len(word)
                        seen[word] += n
                if len(seen) > _PENDING_WORDS or held > _PENDING_BYTES:
                    yield from emit(seen)
                    seen, held = Counter(), 0
        yield from emit(seen)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")


# ---- hashes: sum of (letter + 1) * BASE ** place modulo 2 ** 64, mixed with the length

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(size: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(size - 1, 0), _BASE))]).astype(np.uint64)


def _mix(raw: np.ndarray, size: int) -> np.ndarray:
    h = raw ^ np.uint64(size * 0xD6E8FEB86659FD93 % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``words`` and letters (a matrix) of words of one length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        where = np.flatnonzero(sizes == size)
        yield where, np.frombuffer("".join([words[k] for k in where]).encode("latin-1"), np.uint8).reshape(len(where), size)


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for where, letters in _by_length(words):
        size = letters.shape[1]
        raw = np.zeros(len(where), np.uint64)
        powers = _powers(size)
        for at in range(0, size, 4_096):
            raw += ((letters[:, at:at + 4_096].astype(np.uint64) + np.uint64(1)) * powers[at:at + 4_096]).sum(axis=1, dtype=np.uint64)
        out[where] = _mix(raw, size)
    return out


def vocabulary(docs: DataFrame, letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """word, n, h (hash), size of every word that counts."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("h", pa.int64()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(word_hashes(words).view(np.int64)),
                 pa.array(list(map(len, words)), pa.int32())], schema=schema)

    counted = word_counts(docs, letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counted.mapInArrow(run, "word string, n long, h long, size int")


# ---- blocked Bloom filters, one per length

def shard_of(size: int) -> int:
    """Longer words share one filter: they are few, and the hash knows the length."""
    return min(size, LONGEST_SHARD)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _bits(h: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    out = one << (h & np.uint64(63))
    for k in (6, 12, 18):
        out |= one << ((h >> np.uint64(k)) & np.uint64(63))
    return out


def build_filters(words: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Filter of each shard over ``words`` (h, shard); ``counts``: words of each shard at most."""
    blocks = {s: max(64, -(-n * BITS_PER_WORD // 64)) for s, n in counts.items()}
    if not blocks:
        return {}
    of_shard = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    block = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.element_at(of_shard, F.col("shard")).cast("long"), 32)

    def build(key, table):
        shard, segment = (k.as_py() for k in key)
        h = table["h"].to_numpy().view(np.uint64)
        part = np.zeros(min(SEGMENT, blocks[shard] - segment * SEGMENT), np.uint64)
        np.bitwise_or.at(part, (_block(h, blocks[shard]) - np.uint64(segment * SEGMENT)).astype(np.int64), _bits(h))
        return pa.table({"shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int64()),
                         "data": pa.array([part.tobytes()], pa.binary())})

    built = words.withColumn("segment", F.floor(block / SEGMENT)).groupBy("shard", "segment").applyInArrow(
        build, "shard int, segment long, data binary")
    out = {s: np.zeros(n, np.uint64) for s, n in blocks.items()}
    for row in built.collect():  # the filters themselves: FILTER_BYTES at most
        part = np.frombuffer(row["data"], np.uint64)
        out[row["shard"]][row["segment"] * SEGMENT:row["segment"] * SEGMENT + len(part)] = part
    return out


def maybe(filters: dict[int, np.ndarray], size: int, h: np.ndarray) -> np.ndarray:
    """Whether a word of this hash may be in the vocabulary."""
    held = filters.get(shard_of(size))
    if held is None:
        return np.zeros(len(h), bool)
    bits = _bits(h)
    return (held[_block(h, len(held)).astype(np.int64)] & bits) == bits


def positive_edits(letters: np.ndarray, filters: dict[int, np.ndarray], alphabet: np.ndarray, residue: int = 0,
                   passes: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows of ``letters``, places, edit hashes and put letter (0: deletion) of edits that pass the filters."""
    n, size = letters.shape
    powers = _powers(size)
    rows_at_once = max(1, _BLOCK // size)

    def probe(raw: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(raw, target)
        ok = maybe(filters, target, h)
        if passes > 1:
            ok &= h % np.uint64(passes) == np.uint64(residue)
        return h, np.flatnonzero(ok)

    for top in range(0, n, rows_at_once):
        rows = letters[top:top + rows_at_once]
        whole = np.zeros(len(rows), np.uint64)
        for at in range(0, size, _BLOCK):
            whole += ((rows[:, at:at + _BLOCK].astype(np.uint64) + np.uint64(1)) * powers[at:at + _BLOCK]).sum(axis=1, dtype=np.uint64)
        before = np.zeros(len(rows), np.uint64)
        for at in range(0, size, _BLOCK):  # one block of places of very long words, all places of others
            some = rows[:, at:at + _BLOCK]
            terms = (some.astype(np.uint64) + np.uint64(1)) * powers[at:at + _BLOCK]
            upto = before[:, None] + np.cumsum(terms, axis=1, dtype=np.uint64)
            # Of equal letters in a row only the first is deleted: the others give the same word.
            left = np.column_stack([rows[:, at - 1] if at else np.zeros(len(rows), np.uint8), some[:, :-1]])
            r, c = np.nonzero(some != left)
            raw = upto[r, c] - terms[r, c] + (whole[r] - upto[r, c]) * _BACK
            h, hit = probe(raw, size - 1)
            yield r[hit] + top, c[hit] + at, h[hit], 0
            for letter in alphabet.tolist():
                r, c = np.nonzero(some < letter)
                raw = whole[r] + (np.uint64(letter) - some[r, c].astype(np.uint64)) * powers[at + c]
                h, hit = probe(raw, size)
                yield r[hit] + top, c[hit] + at, h[hit], letter
            before = upto[:, -1]


def candidates(words: DataFrame, filters: dict[int, np.ndarray], alphabet: str, residue: int = 0, passes: int = 1) -> DataFrame:
    """h (word), edit (hash), place, put: edits of every word that pass the filters."""
    shared = words.sparkSession.sparkContext.broadcast((filters, np.frombuffer(alphabet.encode("latin-1"), np.uint8)))
    schema = pa.schema([("h", pa.int64()), ("edit", pa.int64()), ("place", pa.int32()), ("put", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters_in_use = shared.value
        for batch in batches:
            own = batch.column(1).to_numpy(zero_copy_only=False)
            for where, letters in _by_length(batch.column(0).to_pylist()):
                for r, place, h, letter in positive_edits(letters, held, letters_in_use, residue, passes):
                    for at in range(0, len(r), 50_000):
                        some = slice(at, at + 50_000)
                        put = pa.array(["" if not letter else chr(letter)] * len(r[some]), pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[where[r[some]]]), pa.array(h[some].view(np.int64)), pa.array(place[some].astype(np.int32)), put],
                            schema=schema)

    return words.select("word", "h").mapInArrow(run, "h long, edit long, place int, put string")


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, n, other, other_n: every pair of vocabulary words one edit apart, once.

    ``words`` is a written vocabulary.
    """
    sharded = words.withColumn("shard", F.least("size", F.lit(LONGEST_SHARD)))
    counts = {r["shard"]: r["n"] for r in sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    passes = max(1, -(-sum(counts.values()) * BITS_PER_WORD // (8 * filter_bytes)))
    alphabet = "".join(sorted(r["letter"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter"))
                              .filter("letter <> ''").distinct().collect()))  # 90 letters at most
    tasks = max(1, -(-sum(counts.values()) // PROBED_WORDS))  # edits cost far more than reading their words
    dealt, found = words.repartition(tasks, "h"), None
    for residue in range(passes):
        part = sharded
        if passes > 1:  # the hash modulo passes, as an unsigned number
            unsigned = F.pmod(F.shiftrightunsigned("h", 1) % passes * 2 + F.col("h").bitwiseAND(1), F.lit(passes))
            part = sharded.filter(unsigned == residue)
        sizes = counts if passes == 1 else {
            r["shard"]: r["n"] for r in part.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        filters = build_filters(part.select("h", "shard"), sizes)
        one = candidates(dealt, filters, alphabet, residue, passes)
        found = one if found is None else found.unionByName(one)
    targets = words.select(F.col("h").alias("edit"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    spelt = F.expr("concat(substring(word, 1, place), put, substring(word, place + 2))")
    return found.join(targets, "edit").join(words.select("h", "word", "n"), "h").filter(spelt == F.col("other")).select(
        "word", "n", "other", "other_n")


def follow(forms: DataFrame) -> DataFrame:
    """word, root of rows word, form: the last word reached; forms have larger counts, so there is no circle.

    Pointers double each round; a chain has at most one link per factor ``TIMES`` of counts.
    """
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if not moved.filter("moved").take(1):
            return roots


def spelling_variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, times: int = TIMES,
                      filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every vocabulary word.

    A word's form is its near word of largest count (ties: smallest in code-point order) if
    that count is at least ``times`` its own; its root is where forms lead to.
    """
    words = cut_lineage(vocabulary(docs, letters, least))
    both = near_pairs(words, filter_bytes).select(F.explode(F.array(
        F.struct("word", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    takes = -F.col("best.minus") >= times * F.col("n")
    judged = cut_lineage(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.other")).alias("form"),
        F.when(takes, -F.col("best.minus")).alias("form_n")))
    roots = follow(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
