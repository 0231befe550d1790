"""Exact n-gram Jaccard join: prefix filters under several global token orders.

A document's set holds its distinct five-word shingles as 64-bit hashes.  Sets of Jaccard
similarity ``t`` share at least ``t * n`` shingles, so of ``n`` shingles at most
``spare(n) = n - ceil(t * n)`` may be missing from the partner.  Whatever order the
shingles are put in, a document of which more than ``spare(n)`` shingles of a prefix occur
nowhere else has no partner, and partners share one of the first ``spare(n) + 1``.

1. Equal sets collapse to their smallest doc_id.
2. Order A (by hash): among the first 1.25 * spare + 1 shingles count those that another set
   has in its own prefix; partners share a fifth of them, so with fewer there is no partner.
3. Order B (rarest first, by exact counts over the documents left): partners share one of
   the first spare + 1.  Widespread passages come last, so they yield no candidates.
4. In ``ROUNDS`` rounds, within each shared shingle, every document is verified against one
   leader, and documents that link take a common label.  Documents that then still have
   different labels are paired in full.  Pairs of one label are connected already, so a
   group of near copies costs a few stars and not its square.
5. A candidate must have few enough differing bits in small parity maps of the sets, and share
   a shingle in its prefix under order C (another hash), before the sets are intersected.
6. Links become components.

Nothing is capped or sampled.  Sides of joins are broadcast only up to ``SMALL`` rows,
after a count; beyond it the same join shuffles, and a heavy shingle is split by adaptive
skew handling.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text of one to four words is one
shingle; null and empty texts have none and link with nothing.  A repeated doc_id is one
document that holds the sets of all its rows.  Null doc_ids keep their row with a null
component and link with nothing.  An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import SMALL, small, word_numbers
from shelfwatch.operators.components import components
from shelfwatch.session import cut_lineage

N = 5
PERCENT = 80
ROUNDS = 2
MAP_WORDS = 16
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def spare(n, percent: int = PERCENT):
    """Shingles out of ``n`` that a partner may lack; for columns, arrays and numbers alike."""
    return n - (n * percent + 99) // 100


def spare_column(n: Column, percent: int) -> Column:
    return n - F.floor((n * percent + 99) / 100)


def _mixed(h: np.ndarray, key: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * key
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending."""
    words = (text or "").encode().translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_numbers().__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out + h[k:k + len(out)], _MIX)
    return np.unique(out)


def prefix_under(tokens: np.ndarray, key: np.uint64, size: int) -> np.ndarray:
    """The first ``size`` tokens in the order of another hash."""
    if size >= len(tokens):
        return tokens
    order = _mixed(tokens, key)
    return tokens[order <= np.partition(order, size - 1)[size - 1]]


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit map of a set: bit k tells whether an odd number of its tokens fall on k.

    Two maps differ in at most as many bits as the sets have tokens that only one of them holds.
    """
    odd = np.bincount((tokens % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)))


def shingle_sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, set_id (digest of the set, null if empty), prefix (order A) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            prefixes = [s[:spare(len(s), percent) * 5 // 4 + 1] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), _lists(prefixes)],
                schema=_SETS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, set_id binary, prefix array<long>")


def _shared(rows: DataFrame, limit: int) -> DataFrame:
    """doc_id, token, df of the tokens (doc_id, token) that more than one document holds.

    Tokens of two documents are known from their smallest and largest id; only those of
    three or more are looked up again.
    """
    counts = cut_lineage(rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("df > 1"))
    twos = counts.filter("df = 2").select(F.explode(F.array("lo", "hi")).alias("doc_id"), "token", "df")
    more = small(counts.filter("df > 2").select("token", "df"), limit)
    return twos.unionByName(rows.join(more, "token").select("doc_id", "token", "df"))


def _token_rows(sets: DataFrame, column: str) -> DataFrame:
    return sets.select("doc_id", F.explode(column).alias("token"))


def may_have_partner(sets: DataFrame, percent: int = PERCENT, limit: int = SMALL) -> DataFrame:
    """doc_ids that pass the order A filter."""
    found = _shared(_token_rows(sets, "prefix"), limit).groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    # Of two partners one size apart the smaller may have one shingle less to spare: hence the one off.
    need = F.greatest(F.size("prefix") - spare_column(F.col("n"), percent) - 1, F.lit(1))
    return sets.select("doc_id", need.alias("need")).join(found, "doc_id").filter("found >= need").select("doc_id").distinct()


def full_sets(docs: DataFrame, chosen: DataFrame, several: DataFrame, n: int, limit: int) -> DataFrame:
    """doc_id, n, tokens, bits of the chosen documents; repeated rows of a doc_id (``several``) once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), _lists([parity(s) for s in sets])],
                names=["doc_id", "n", "tokens", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = small(several.join(chosen, "doc_id", "left_semi"), limit)
    once = rows.join(small(chosen.join(again, "doc_id", "left_anti"), limit), "doc_id", "left_semi")
    texts = once.unionByName(rows.join(again, "doc_id", "left_semi").distinct())
    return texts.mapInArrow(run, "doc_id long, n long, tokens array<long>, bits array<long>").filter("n > 0")


def postings(sets: DataFrame, percent: int = PERCENT, limit: int = SMALL) -> DataFrame:
    """token, doc_id, n, alone: the order B prefixes, less what no other document holds."""
    shared = _shared(_token_rows(sets, "tokens"), limit)
    lists = shared.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("known"))
    per = sets.groupBy("doc_id").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    several = F.col("least") != F.col("most")
    alone = F.greatest(F.col("most") - F.size("known"), F.lit(0))
    # The sets of a repeated doc_id are put together here: its prefix is all it shares, its size is left open.
    room = F.when(several, F.size("known")).otherwise(F.greatest(spare_column(F.col("most"), percent) + 1 - alone, F.lit(0)).cast("int"))
    return per.join(lists, "doc_id").select(
        "doc_id", F.when(~several, F.col("most")).alias("n"), F.when(~several, alone).alias("alone"),
        F.explode(F.slice("known", F.lit(1), room)).alias("k"),
    ).select(F.col("k.token").alias("token"), "doc_id", "n", "alone")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link; both sets meet in one row by two joins."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (2, 3))
                keep.append(linked(x, y, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return rows.mapInArrow(run, "a long, b long").distinct()


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, after the sizes and the order C prefixes agree."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    heads = [prefix_under(s, _OTHER, spare(len(s), percent) + 1) for s in (x, y)]
    if not len(np.intersect1d(*heads, assume_unique=True)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _fits(percent: int) -> Column:
    """Whether sizes n and m allow a link, given how many shingles either side shares with nobody."""
    most = F.least(F.col("n") - F.col("alone"), F.col("m") - F.col("alone_m"))
    return F.coalesce(100 * most >= percent * (F.col("n") + F.col("m") - most), F.lit(True))


def _maps_fit(percent: int) -> Column:
    """Whether the bit maps differ in few enough places for a link; cheaper than the sets by far."""
    differ = reduce(Column.__add__, [
        F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(MAP_WORDS)])
    # differ <= n + m - 2 * overlap, and a link needs (100 + percent) * overlap >= percent * (n + m).
    return F.coalesce((100 + percent) * (F.col("n") + F.col("m") - differ) >= 2 * percent * (F.col("n") + F.col("m")), F.lit(True))


def _star(rows: DataFrame, seed: int, percent: int) -> DataFrame:
    """a, b, from, to: in every token the rows that don't have the leader's label yet, against the leader.

    The first leader is the row with the fewest shingles of its own, the likeliest original;
    later ones are picked by a hash.
    """
    rank = F.struct("alone", "doc_id") if seed == 0 else F.struct(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    leaders = rows.groupBy("token").agg(F.min_by(F.struct("doc_id", "n", "alone", "label"), rank).alias("l")).select(
        "token", F.col("l.doc_id").alias("a"), F.col("l.n").alias("m"), F.col("l.alone").alias("alone_m"), F.col("l.label").alias("to"))
    return rows.join(leaders, "token").filter((F.col("label") != F.col("to")) & _fits(percent)).select(
        "a", F.col("doc_id").alias("b"), F.col("label").alias("from"), "to").dropDuplicates(["a", "b"])


def _relabel(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after merging label pairs (x, y): every label follows its smallest partner, and that one's."""
    both = merged.select("x", "y").unionByName(merged.select(F.col("y").alias("x"), F.col("x").alias("y")))
    step = both.groupBy(F.col("x").alias("label")).agg(F.min("y").alias("to")).filter("to < label")
    onward = step.select(F.col("label").alias("to"), F.col("to").alias("further"))
    named = step.join(onward, "to", "left").select("label", F.coalesce("further", "to").alias("new"))
    return rows.join(named, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of tokens in which more than one label is left."""
    mixed = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("token")
    return rows.join(mixed, "token", "left_semi")


def links(sets: DataFrame, percent: int = PERCENT, limit: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """a, b: verified links that connect whatever links connect."""
    posted = cut_lineage(postings(sets, percent, limit))
    sets = sets.join(small(posted.select("doc_id").distinct(), limit), "doc_id", "left_semi")
    rows = cut_lineage(_open(posted.withColumn("label", F.col("doc_id"))))
    tested, found = [], []
    for seed in range(rounds):
        star = cut_lineage(_star(rows, seed, percent))
        hit = cut_lineage(verify(star.select("a", "b"), sets, percent))
        tested.append(star.select("a", "b"))
        found.append(hit)
        merged = star.join(hit, ["a", "b"], "left_semi").select(F.col("from").alias("x"), F.col("to").alias("y")).distinct()
        rows = cut_lineage(_open(_relabel(rows, merged)))
    heads = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("token")).alias("head"))
    maps = sets.groupBy("doc_id").agg(F.first("bits").alias("bits"))
    rows = cut_lineage(rows.join(heads.join(maps, "doc_id"), "doc_id"))
    other = rows.select(*[F.col(c).alias(d) for c, d in (
        ("token", "token_b"), ("doc_id", "b"), ("n", "m"), ("alone", "alone_m"), ("label", "label_b"), ("head", "head_b"), ("bits", "bits_b"))])
    # A pair is taken in the first of its common tokens only, and only if its labels still differ.
    across = rows.withColumnRenamed("doc_id", "a").join(
        other, (F.col("token") == F.col("token_b")) & (F.col("a") < F.col("b")) & (F.col("label") != F.col("label_b")) & _fits(percent)
        & _maps_fit(percent) & (F.get(F.array_intersect("head", "head_b"), F.lit(0)) == F.col("token"))).select("a", "b")
    known = reduce(DataFrame.unionByName, tested).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = across.join(known.distinct(), ["a", "b"], "left_anti")
    return reduce(DataFrame.unionByName, found).unionByName(verify(fresh, sets, percent))


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT, limit: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    sets = cut_lineage(shingle_sets(docs, n, percent))
    same = sets.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last")
    copies = cut_lineage(sets.select("doc_id", "set_id").join(same, "set_id").filter("doc_id <> first").select(
        F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct())
    # A doc_id that is a copy by one row and not by another stays in: it may link by the other.
    rows = sets.filter("set_id is not null and doc_id is not null")
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    gone = copies.select(F.col("b").alias("doc_id")).distinct().join(several, "doc_id", "left_anti")
    distinct = rows.join(small(gone, limit), "doc_id", "left_anti")
    chosen = cut_lineage(may_have_partner(distinct, percent, limit))
    full = cut_lineage(full_sets(docs, chosen, several, n, limit))
    nodes = components(copies.unionByName(links(full, percent, limit)))
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(
        nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT, limit: int = SMALL) -> DataFrame:
    """The documents, all their columns, one of each group: that of the smallest doc_id.

    Of the rows of a repeated doc_id the smallest stays, column by column.  Null doc_ids stay.
    """
    groups = near_duplicates(docs, n, percent, limit)
    gone = small(groups.filter("doc_id <> component_id").select("doc_id").distinct(), limit)
    several = small(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), limit)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    first = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return kept.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(first)
