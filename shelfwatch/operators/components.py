"""Connected components by alternating large-star / small-star rounds.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Edges
only ever point to smaller ids, so the root of a finished star is the smallest id.

A large graph with many edges a node is first cut to two edges a node, after Sutton et al.,
"Optimizing parallel graph connectivity computation via subgraph sampling" (2018): nearly all
edges lie inside the components of that part and never enter a round.  The others do, so the
components are those of all edges.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.operators.joins import HOT_MIN_ROWS, join_weighted
from shelfwatch.session import cut_lineage

MAX_ROUNDS = 64

# From so many edges on, and with more than so many a node, rounds start from two edges a node.
DENSE_FROM = 1_000_000
DENSE = 4


def _state(edges: DataFrame) -> tuple[int, object]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("digest")
    ).first()
    return row["n"], row["digest"]


def _large_star(edges: DataFrame, total: int, min_hot: int) -> DataFrame:
    """Every larger neighbour of u moves to the smallest id around u."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    around = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
    up = edges.select(F.col("lo").alias("u"), F.col("hi"))
    joined = join_weighted(up, around, "u", "deg", 2 * total, 2 * total, min_hot)
    return joined.select(F.col("m").alias("lo"), "hi").distinct()


def _small_star(edges: DataFrame, total: int, min_hot: int) -> DataFrame:
    """Every smaller neighbour of u, and u itself, moves to the smallest id below u."""
    below = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("deg"))
    moved = join_weighted(edges, below, "hi", "deg", total, total, min_hot).filter(F.col("lo") != F.col("m"))
    return (
        moved.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        .unionByName(below.select(F.col("m").alias("lo"), "hi"))
        .distinct()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b", min_hot: int = HOT_MIN_ROWS, dense_from: int = DENSE_FROM) -> DataFrame:
    """(node, component) of every node on an edge; component = smallest node id in it.

    Hubs above the hot-key bound join by a bounded broadcast; each round continues from
    a written table.
    """
    current = cut_lineage(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    )
    total, digest = _state(current)
    if total >= dense_from:
        ends = current.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            current.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        picked = cut_lineage(ends.groupBy("u").agg(F.min("v").alias("first"), F.max("v").alias("last")))
        if total > DENSE * picked.count():
            return _from_sparse(current, picked, min_hot)
    return _stars(current, total, digest, min_hot)


def _from_sparse(current: DataFrame, picked: DataFrame, min_hot: int) -> DataFrame:
    """Components of the picked edges, joined by the edges that lead from one to another."""
    kept = picked.select("u", F.explode(F.array("first", "last")).alias("v")).select(
        F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    kept = cut_lineage(kept.distinct())
    parts = _stars(kept, *_state(kept), min_hot)
    lo, hi = (parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")) for end in ("lo", "hi"))
    between = current.join(lo, "lo").select("lo_part", "hi").join(hi, "hi").filter("lo_part != hi_part").select(
        F.least("lo_part", "hi_part").alias("lo"), F.greatest("lo_part", "hi_part").alias("hi"))
    between = cut_lineage(between.distinct())
    left, digest = _state(between)
    if not left:
        return parts
    whole = _stars(between, left, digest, min_hot).select(F.col("node").alias("component"), F.col("component").alias("_whole"))
    return parts.join(whole, "component", "left").select("node", F.coalesce("_whole", "component").alias("component"))


def _stars(current: DataFrame, total: int, digest, min_hot: int) -> DataFrame:
    """Components of stored distinct edges."""
    for _ in range(MAX_ROUNDS):
        step = _small_star(_large_star(current, total, min_hot), total, min_hot)
        current = cut_lineage(step)
        before, (total, digest) = (total, digest), _state(current)
        if before == (total, digest):
            break
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return members.unionByName(roots)


def group_components(rows: DataFrame, group: str, item: str, min_hot: int = HOT_MIN_ROWS, dense_from: int = DENSE_FROM) -> DataFrame:
    """(node, component) of groups linked through shared items; component = smallest group id in it.

    Every group ties its items to its smallest one, so the rounds run over items alone; groups
    follow the smallest of their items at the end.  Rows without a group or an item are left out.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g IS NOT NULL AND i IS NOT NULL")
    firsts = cut_lineage(rows.groupBy("g").agg(F.min("i").alias("first")))
    ties = rows.join(firsts, "g").filter("i != first").select("first", "i")
    tied = components(ties, "first", "i", min_hot, dense_from)
    led = firsts.groupBy("first").agg(F.min("g").alias("least"), F.count(F.lit(1)).alias("n"))
    led = led.join(tied.select(F.col("node").alias("first"), F.col("component").alias("c")), "first", "left")
    led = cut_lineage(led.withColumn("c", F.coalesce("c", "first")))
    size = led.agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("groups"), F.max("n").alias("heaviest")).first()
    smallest = led.groupBy("c").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("k"))
    placed = join_weighted(led, smallest, "c", "k", size["items"], size["items"], min_hot).select("first", "n", "component")
    return join_weighted(firsts, placed, "first", "n", size["groups"] or 0, size["heaviest"] or 0, min_hot).select(
        F.col("g").alias("node"), "component")
