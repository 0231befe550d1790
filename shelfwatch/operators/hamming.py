"""Near-equal 64-bit hashes: exact Hamming join by shared bit segments.

With 64 bits cut into s segments, two hashes at distance <= d agree on at least
s - d whole segments.  Keying every hash by all combinations of s - d segments
therefore finds every pair.  More segments give longer, more selective keys.

Nothing is capped.  Copies of one hash are collapsed before the join.  A bucket too
large for one task is keyed again on the bits that vary inside it, and what is still
large is split into bounded chunk pairs, each compared by its own task.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.constants import MAX_HASH_DISTANCE
from shelfwatch.functions.bits import hamming
from shelfwatch.operators.joins import join_weighted
from shelfwatch.session import cut_lineage

MAX_DISTANCE = 7
BUCKET_ROWS = 4096
MAX_KEY_SEGMENTS = 4


@dataclass(frozen=True)
class Band:
    mask: int                  # bits forming the key
    skipped: tuple[int, ...]   # earlier segments left out: a pair agreeing on one belongs to an earlier band


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def band_plan(distance: int, segments: int) -> list[Band]:
    """All segment combinations with their key masks, in a fixed order."""
    edges = [64 * i // segments for i in range(segments + 1)]
    pieces = [list(range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    size = min(segments - distance, MAX_KEY_SEGMENTS)
    plan = []
    for combo in combinations(range(segments), size):
        used = [p for s in combo for p in pieces[s]]
        skipped = [s for s in range(combo[-1]) if s not in combo]
        plan.append(Band(
            _signed(sum(1 << p for p in used)),
            tuple(_signed(sum(1 << p for p in pieces[s])) for s in skipped),
        ))
    return plan


def segments_for(n: int, distance: int) -> int:
    """More hashes need longer keys; short keys mean less shuffle when hashes are few."""
    extra = 0 if n < 2_000_000 else 1 if n < 50_000_000 else 2
    return max(8, distance + 1) + extra


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")


def _table(rows) -> Column:
    return F.array(*[_longs(r) for r in rows])


def _differs_on_all(x: Column, masks: Column, count: int, below: Column | None = None) -> Column:
    """Does ``x`` have a bit in each of the masks (only those numbered under ``below``, if given)?"""
    ok = F.lit(True)
    for i in range(count):
        hit = F.coalesce(x.bitwiseAND(F.get(masks, F.lit(i))) != 0, F.lit(True))
        ok = ok & (hit if below is None else (F.lit(i) >= below) | hit)
    return ok


def _deal_bits(bits: Column, groups: int) -> Column:
    """The set bits dealt out evenly to ``groups`` masks."""
    positions = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.getbit(bits, p) == 1)

    def mask(group: int) -> Column:
        mine = F.filter(positions, lambda p, i: i % groups == group)
        one = F.lit(1).cast("long")
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", one, p)))

    return F.array(*[mask(g) for g in range(groups)])


def _keys_of(plan: list[Band]) -> Column:
    return F.array(*[F.col("h").bitwiseAND(F.lit(b.mask).cast("long")) for b in plan])


def band_keys(distance: int, segments: int) -> Column:
    """Keys of column ``h``, one per band of the plan."""
    return _keys_of(band_plan(distance, segments))


def distinct_hashes(df: DataFrame, row_id: str = "id", value: str = "h") -> DataFrame:
    """One row per hash value: smallest id and number of copies."""
    return df.groupBy(value).agg(F.min(row_id).alias("rep"), F.count(F.lit(1)).alias("copies"))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], distance: int, also: list[Column]) -> DataFrame:
    """Self join of one bucket; the cheap bit count comes first, it rejects almost every candidate."""
    left, right = left.alias("l"), right.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    return left.join(right, [*same, hamming(F.col("l.h"), F.col("r.h")) <= distance, *also])


def near_pairs(
    reps: DataFrame, distance: int = MAX_HASH_DISTANCE, n: int | None = None,
    segments: int | None = None, bucket_rows: int = BUCKET_ROWS, fresh: str | None = None,
) -> DataFrame:
    """(a, b, distance) of all distinct hashes (rep, h) at most ``distance`` bits apart; a < b, each pair once.

    With ``fresh``, a boolean column, only pairs of which one side at least is fresh.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be 0..{MAX_DISTANCE}")
    own = ["rep", "h", *([fresh] if fresh else [])]
    reps = reps.select(*own)
    n = reps.count() if n is None else n
    plan = band_plan(distance, segments or segments_for(n, distance))
    h = F.col("h")
    keyed = reps.select(*own, F.posexplode(_keys_of(plan)).alias("band", "key"))
    wanted = [F.col(f"l.{fresh}") | F.col(f"r.{fresh}")] if fresh else []

    skipped, most = _table([b.skipped for b in plan]), max(len(b.skipped) for b in plan)
    x = F.col("l.h").bitwiseXOR(F.col("r.h"))
    ordered = F.col("l.rep") < F.col("r.rep")
    owner = _differs_on_all(x, F.get(skipped, F.col("l.band")), most)
    columns = [
        F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"),
        hamming(F.col("l.h"), F.col("r.h")).cast("int").alias("distance"),
    ]
    # Every key learns the size of its bucket and which bits vary in it.  Lone keys drop
    # out, and so do buckets whose members all agree on an earlier skipped segment: every
    # pair in them belongs to an earlier band.  The size join and the pair join share one
    # partitioning by (band, key).
    bucket = ["band", "key"]
    sizes = cut_lineage(keyed.groupBy(*bucket).agg(
        F.count(F.lit(1)).alias("size"), F.bit_or("h").bitwiseXOR(F.bit_and("h")).alias("varies")
    ).filter("size > 1").filter(_differs_on_all(F.col("varies"), F.get(skipped, F.col("band")), most)))
    calm = keyed.join(sizes.filter(F.col("size") <= bucket_rows).select(*bucket), bucket)
    out = _pairs(calm, calm, bucket, distance, [ordered, owner, *wanted]).select(*columns)

    # Key crowded buckets again on d + 1 groups of their varying bits: two members within
    # d agree on at least one group.
    groups = distance + 1
    crowded = sizes.filter(F.col("size") > bucket_rows).select(*bucket, _deal_bits(F.col("varies"), groups).alias("masks"))
    fine = keyed.join(crowded, bucket).select(*own, *bucket, "masks", F.posexplode("masks").alias("part", "mask")).select(
        *own, *bucket, "masks", "part", h.bitwiseAND(F.col("mask")).alias("sub")
    )
    place = [*bucket, "part", "sub"]
    chunks = fine.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select(
        *place, F.ceil(F.col("size") / F.lit(bucket_rows)).cast("int").alias("chunks")
    )
    placed = fine.join(chunks, place).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int"))
    # Chunk i meets chunk j (i <= j) in cell (i, j): bounded work per cell, every pair in exactly one.
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        *own, *place, "masks", "chunk",
        F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
    )
    same_cell = (F.col("l.lo") < F.col("l.hi")) | ordered
    first_group = _differs_on_all(x, F.col("l.masks"), groups, F.col("l.part"))
    dense = _pairs(
        cells.filter(F.col("chunk") == F.col("lo")), cells.filter(F.col("chunk") == F.col("hi")),
        [*place, "lo", "hi"], distance, [same_cell, owner, first_group, *wanted],
    )
    return out.unionByName(dense.select(*columns))


def copy_edges(df: DataFrame, reps: DataFrame, total: int, heaviest: int, row_id: str = "id", value: str = "h") -> DataFrame:
    """Star edges from the smallest id of a hash to every other copy: n - 1 rows for n copies."""

    joined = join_weighted(df.select(row_id, value), reps, value, "copies", total, heaviest)
    return joined.filter(F.col(row_id) != F.col("rep")).select(
        F.col("rep").alias("a"), F.col(row_id).alias("b"), F.lit(0).alias("distance")
    )


def hamming_pairs(df: DataFrame, row_id: str = "id", value: str = "h", distance: int = MAX_HASH_DISTANCE, **tuning) -> DataFrame:
    """Edges whose components are the look-alike groups: near pairs of distinct hashes plus copy stars."""
    reps = cut_lineage(distinct_hashes(df, row_id, value).withColumnRenamed(value, "h"))
    size = reps.agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows"), F.max("copies").alias("top")).first()
    near = near_pairs(reps, distance, size["n"], **tuning)
    copies = copy_edges(
        df.select(row_id, F.col(value).alias("h")), reps, size["rows"] or 0, size["top"] or 0, row_id, "h"
    )
    return near.unionByName(copies)
