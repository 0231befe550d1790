"""Hamming join and components against brute force."""
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwatch.operators.components import components
from shelfwatch.operators.hamming import band_plan, hamming_pairs, near_pairs
from shelfwatch.plans.matching import match_products


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(hashes, d):
    items = sorted(hashes)
    return {(a, b, (x ^ y).bit_count()) for i, (a, x) in enumerate(items) for b, y in items[i + 1:]
            if (x ^ y).bit_count() <= d}


def clustered(n, seed, spread=9):
    """Random centres with close variants, so every distance up to the limit occurs."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(enumerate(sorted(out)))


def frame(spark, rows):
    return spark.createDataFrame([(i, signed(x)) for i, x in rows], "rep long, h long")


@pytest.mark.parametrize("distance,segments", [(0, 8), (3, 8), (6, 8), (6, 9), (6, 10), (7, 8)])
def test_pairs_equal_brute_force(spark, distance, segments):
    rows = clustered(400, distance * 10 + segments)
    got = near_pairs(frame(spark, rows), distance, segments=segments).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows, distance)


def test_crowded_buckets_are_exact(spark):
    """A third of the hashes share four bytes: buckets are keyed again and split, nothing is lost or doubled."""
    rng = random.Random(5)
    crowd = {(0xABCDEF01 << 32) | rng.getrandbits(10) << 4 for _ in range(300)}
    rows = clustered(500, 3)
    rows += [(10000 + i, x) for i, x in enumerate(sorted(crowd - {x for _, x in rows}))]
    got = near_pairs(frame(spark, rows), 6, bucket_rows=16).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {tuple(r) for r in got} == brute(rows, 6)


def test_plan_keys():
    assert [len(band_plan(6, s)) for s in (8, 9, 10)] == [28, 84, 210]
    assert all(band.mask & m == 0 for band in band_plan(6, 9) for m in band.skipped)


def test_varying_bits_are_dealt_out(spark):
    from shelfwatch.operators.hamming import _deal_bits

    values = [-1, 0b1011011, 1 << 62 | 5, -(1 << 63)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", _deal_bits(F.col("v"), 7).alias("m"))
    for r in df.collect():
        union = 0
        for m in r["m"]:
            assert union & m == 0
            union |= m
        assert union == r["v"] and len(r["m"]) == 7


def test_distance_limit(spark):
    with pytest.raises(ValueError):
        near_pairs(frame(spark, [(1, 1)]), 8)


def find_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("name", ["chain", "star", "random", "two"])
@pytest.mark.parametrize("min_hot", [1, 1_000_000])
def test_components(spark, name, min_hot):
    rng = random.Random(11)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(300)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)],
        "two": [(1, 2), (8, 9), (9, 7)],
    }[name]
    edges = [e for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), min_hot=min_hot).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == find_components(edges)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=40))
def test_components_property(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == find_components(edges)


def test_chain_group_keeps_far_member(spark):
    base = 0b1111
    far = base ^ (0b11111 << 10)
    rows = [(1, 1, base), (2, 2, far), (3, 1, far ^ (0b11111 << 20)), (7, 5, 0x0FFFFFF << 36), (8, 5, (0x0FFFFFF << 36) | 1 << 30)]
    got = {tuple(r) for r in match_products(spark.createDataFrame(rows, "id long, store_id long, h long")).collect()}
    assert got == {(1, 1, 0), (2, 1, 5), (3, 1, 10)}


def test_copies_make_star_edges_only(spark):
    rows = [(i, i % 3, 42) for i in range(1, 101)]
    edges = hamming_pairs(spark.createDataFrame(rows, "id long, store_id long, h long")).collect()
    assert len(edges) == 99 and {r["a"] for r in edges} == {1}
    assert match_products(spark.createDataFrame(rows, "id long, store_id long, h long")).filter("canonical_id = 1 AND distance = 0").count() == 100


def test_hot_hash_joins_by_bounded_broadcast(spark):
    from shelfwatch.operators.joins import join_weighted

    fact = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), "id")
    dim = fact.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    out = join_weighted(fact, dim, "k", "w", 1000, 400, min_rows=50)
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000


def test_days_add_up_to_a_full_run(spark):
    """Close hashes, copies and repeated days: the stored groups equal those of one run over everything."""
    from shelfwatch.operators.match_index import MatchIndex
    from shelfwatch.session import scratch_path

    rows = clustered(150, 17, spread=6)
    rng = random.Random(4)
    listed = [(10 * i + k, rng.randrange(5), signed(x)) for i, x in rows for k in range(rng.choice([1, 1, 2]))]
    rng.shuffle(listed)
    table = lambda some: spark.createDataFrame(some, "id long, store_id long, h long")
    index = MatchIndex(spark, scratch_path(spark, "index"), parts=8)
    index.add_day("2024-01-01", table(listed[:100]))
    index.add_day("2024-01-02", table(listed[100:]))
    index.add_day("2024-01-02", table(listed[100:]))
    assert sorted(map(tuple, index.matches().collect())) == sorted(map(tuple, match_products(table(listed)).collect()))
    assert {r["day"] for r in index.table("bands").select("day").distinct().collect()} == {"2024-01-01", "2024-01-02"}


@pytest.mark.parametrize("name", ["dense", "islands", "hubs"])
def test_dense_components(spark, name):
    """Rounds that start from two edges a node give the components of all edges."""
    rng = random.Random(5)
    pair = lambda a, b: (rng.randrange(a, b), rng.randrange(a, b))
    edges = {
        "dense": [pair(0, 40) for _ in range(900)],
        # A node's first and last neighbour lie in its own island; only others lead out of it.
        "islands": [pair(60 * k, 60 * k + 20) for k in range(6) for _ in range(160)] + [(60 * k + 9, 60 * k + 70) for k in (0, 1, 3)],
        "hubs": [(h, 100 + k) for h in range(8) for k in range(120)] + [(900, 901)],
    }[name]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    got = components(spark.createDataFrame(edges, "a long, b long"), min_hot=1, dense_from=0).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == find_components(edges)


def test_few_edges_of_a_dense_graph_enter_the_rounds(spark, monkeypatch):
    from shelfwatch.operators import components as module

    rows, stars = [], module._stars
    monkeypatch.setattr(module, "_stars", lambda current, *rest: rows.append(current.count()) or stars(current, *rest))
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60)]
    got = module.components(spark.createDataFrame(edges, "a long, b long"), dense_from=0).collect()
    assert {r["component"] for r in got} == {0} and len(got) == 60 and sum(rows) <= 120


@pytest.mark.parametrize("dense_from", [0, 1_000_000])
def test_groups_linked_through_items(spark, dense_from):
    from shelfwatch.operators.components import group_components

    rng = random.Random(8)
    rows = [(g, 40 * (g % 5) + rng.randrange(0, 30)) for g in range(300, 420) for _ in range(rng.randrange(1, 7))]
    rows += [(500, 999), (500, 999), (501, 998), (502, 998), (0, 7)]
    found = find_components([(g, 10**6 + i) for g, i in rows])
    got = group_components(spark.createDataFrame([*rows, (None, 7), (503, None)], "o long, p long"), "o", "p", min_hot=1, dense_from=dense_from)
    assert sorted(map(tuple, got.collect())) == sorted((n, c) for n, c in found.items() if n < 10**6)
