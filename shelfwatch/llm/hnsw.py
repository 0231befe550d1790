"""Embedding near-duplicates by navigable small-world graphs, one per shard.

1. Vectors that can't link (null, zero, null or non-finite components, null label) are set
   aside; equal unit vectors of a label collapse to the smallest vec_id with a weight.
2. Each label is cut into shards of about ``SHARD_ROWS`` vectors by id hash, and a
   hierarchical graph is built per shard.
3. Every vector queries every shard of its label: one task per pair of shards builds both
   graphs and sends each side's vectors through the other's.
4. A query whose worst beam entry still reaches the threshold has its beam doubled until
   it doesn't.  Every task has an audit: exact products of blocks of its queries, until
   ``AUDIT_LINKED`` queries with links to others are seen.  Below ``RECALL`` on those all
   beams of the task double and the search goes on.  Where links are so rare that the
   audit gets through all queries, its links are the answer and no graph is built.
5. Cosines are verified in double precision; links of a task are kept as one bit matrix, so
   that a dense group costs bits, not rows: a task returns link counts and a spanning forest.
6. Forests are united into components.

Rows that repeat a vec_id with other contents are one vector holding all of them: links are
summed over the contents, and the component joins them.  A vector that links with nothing is its own component.  Empty tables give an
empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.operators.components import components
from shelfwatch.session import cut_lineage

THRESHOLD = 0.93
SHARD_ROWS = 8_192
NEIGHBOURS = 12
BUILD_BEAM = 40
SEARCH_BEAM = 32
AUDIT_LINKED = 128
AUDIT_BLOCK = 256
RECALL = 0.98
BLOCK = 1_024


class Graph:
    """A hierarchical small-world graph over unit vectors; inserts and searches in blocks.

    ``links[level]`` is a table of neighbour places (-1: none); a vector's top level comes
    from a hash of its place, so a rebuilt graph is the same graph.
    """

    def __init__(self, vectors: np.ndarray, m: int = NEIGHBOURS, beam: int = BUILD_BEAM):
        self.x, self.m = np.ascontiguousarray(vectors, np.float32), m
        n = len(vectors)
        draw = np.random.default_rng(11).random(n)
        top = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int), 6)
        order = np.argsort(-top, kind="stable")  # higher levels first: each block finds its entry points in place
        self.links = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(top.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        self.top = top
        done = 1
        while done < n:
            block = order[done:done + max(1, min(done, BLOCK))]
            self._insert(block, beam)
            done += len(block)

    def _insert(self, block: np.ndarray, beam: int) -> None:
        at = np.full(len(block), self.entry, np.int64)
        for level in range(len(self.links) - 1, -1, -1):
            ins = self.top[block] >= level
            if (~ins).any():
                at[~ins] = self._search(self.x[block[~ins]], at[~ins, None], level, 1)[0][:, 0]
            if ins.any():
                new = block[ins]
                found, near = self._search(self.x[new], at[ins, None], level, beam)
                at[ins] = found[:, 0]
                inner = self.x[new] @ self.x[new].T  # the block's own members are candidates as well
                np.fill_diagonal(inner, -2)
                k = min(self.m, len(new))
                own = np.argpartition(-inner, k - 1, axis=1)[:, :k]
                found = np.hstack([found, new[own]])
                near = np.hstack([near, np.take_along_axis(inner, own, axis=1)])
                found[near < -1.5] = -1
                self._connect(new, found, near, level)

    def _pick(self, found: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
        """Half nearest, half spread out: a candidate nearer to a chosen one than to the point waits."""
        order = np.argsort(-near, axis=1, kind="stable")
        found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
        rows, width_in = found.shape
        vectors = self.x[np.maximum(found, 0)]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        chosen = np.zeros(found.shape, bool)
        cover = np.full(found.shape, -2.0, np.float32)
        count = np.zeros(rows, int)
        for c in range(width_in):
            take = (found[:, c] >= 0) & (cover[:, c] < near[:, c]) & (count < width)
            chosen[take, c] = True
            count += take
            cover[take] = np.maximum(cover[take], between[take, c])
        rest = np.cumsum(~chosen & (found >= 0), axis=1) <= (width - count)[:, None]
        chosen |= rest & (found >= 0)
        score = np.where(chosen, -np.arange(width_in), -width_in - 1)
        best = np.argsort(-score, axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(np.where(chosen, found, -1), best, 1)
        if out.shape[1] < width:
            out = np.hstack([out, np.full((rows, width - out.shape[1]), -1, out.dtype)])
        return out

    def _connect(self, new: np.ndarray, found: np.ndarray, near: np.ndarray, level: int) -> None:
        table = self.links[level]
        table[new] = self._pick(found, near, self.m if level else self.m + self.m // 2) if level else np.pad(
            self._pick(found, near, self.m + self.m // 2), ((0, 0), (0, table.shape[1] - self.m - self.m // 2)), constant_values=-1)
        src = np.repeat(new, table.shape[1])
        dst = table[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, size = np.unique(dst, return_index=True, return_counts=True)
        width = int(size.max(initial=0))
        back = np.full((len(nodes), width), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), size), np.arange(len(dst)) - np.repeat(first, size)] = src
        for s in range(0, len(nodes), BLOCK):
            part, some = nodes[s:s + BLOCK], back[s:s + BLOCK]
            both = np.hstack([table[part], some])
            both = np.sort(both, axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(axis=1) > table.shape[1]
            slim = np.sort(both[~full], axis=1)[:, ::-1][:, :table.shape[1]]
            table[part[~full], :slim.shape[1]] = slim
            table[part[~full], slim.shape[1]:] = -1
            if full.any():
                crowd = both[full]
                sims = np.einsum("ij,ikj->ik", self.x[part[full]], self.x[np.maximum(crowd, 0)])
                sims[crowd < 0] = -2
                table[part[full]] = self._pick(crowd, sims, table.shape[1])

    def _search(self, queries: np.ndarray, start: np.ndarray, level: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``beam`` best found for every query, best first."""
        q, table = len(queries), self.links[level]
        seen = np.zeros((q, len(self.x)), bool)
        rows = np.arange(q)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -2.0, np.float32)
        open_ = np.zeros((q, beam), bool)
        width = min(beam, start.shape[1])
        ids[:, :width] = start[:, :width]
        sims[:, :width] = np.einsum("ij,ikj->ik", queries, self.x[start[:, :width]])
        open_[:, :width] = True
        seen[rows[:, None], start[:, :width]] = True
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims, open_ = (np.take_along_axis(a, order, 1) for a in (ids, sims, open_))
        live, step = rows, max(1, beam // 12)  # so many candidates are opened at a time
        while True:
            live = live[open_[live].any(axis=1)]
            if not len(live):
                break
            now = open_[live]
            now &= np.cumsum(now, axis=1) <= step
            open_[live] &= ~now
            width = int(now.sum(axis=1).max())
            first = np.argsort(~now, axis=1, kind="stable")[:, :width]
            near = table[np.where(np.take_along_axis(now, first, 1), np.take_along_axis(ids[live], first, 1), -1)]
            near[~np.take_along_axis(now, first, 1)] = -1
            near = np.sort(near.reshape(len(live), -1), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            seen[np.repeat(live, near.shape[1])[fresh.ravel()], near[fresh]] = True
            r, c = np.nonzero(fresh)
            s = np.full(near.shape, -2.0, np.float32)
            s[r, c] = np.einsum("ij,ij->i", queries[live[r]], self.x[near[r, c]])
            all_s = np.hstack([sims[live], s])
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_s, order, 1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], near]), order, 1)
            open_[live] = np.take_along_axis(np.hstack([open_[live], fresh]), order, 1)
        ids[sims < -1.5] = -1
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Descend from the top level with one candidate, then a full beam at the bottom."""
        at = np.full((len(queries), 1), self.entry, np.int64)
        for level in range(len(self.links) - 1, 0, -1):
            at = self._search(queries, at, level, 1)[0]
        return self._search(queries, at, 0, beam)


def _sure(exact_q: np.ndarray, exact_x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the pairs of places reach the threshold in double precision."""
    return np.concatenate([np.zeros(0, bool)] + [
        np.einsum("ij,ij->i", exact_q[a[i:i + 65536]], exact_x[b[i:i + 65536]]) >= threshold for i in range(0, len(a), 65536)])


def audit(exact_x: np.ndarray, exact_q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries in the order they were compared with everything, and the bit matrix of their links.

    A query that is itself among the vectors (``exact_q is exact_x``) doesn't link with itself.
    Ends when ``AUDIT_LINKED`` queries have links, or after all queries.
    """
    order = np.random.default_rng(13).permutation(len(exact_q))
    truth = np.zeros((len(exact_q), len(exact_x)), bool)
    x, linked, done = exact_x.astype(np.float32), 0, 0
    while done < len(order) and linked < AUDIT_LINKED:
        some = order[done:done + AUDIT_BLOCK]
        r, c = np.nonzero(exact_q[some].astype(np.float32) @ x.T >= threshold - 1e-4)
        a = some[r]
        sure = _sure(exact_q, exact_x, a, c, threshold)
        if exact_q is exact_x:
            sure &= a != c
        truth[a[sure], c[sure]] = True
        linked += len(np.unique(a[sure]))
        done += len(some)
    return order[:done], truth


def _recall(found: np.ndarray, truth: np.ndarray) -> float:
    """Recall over all links, or averaged over the queries that have any, whichever is lower."""
    wanted = truth.sum(axis=1)
    got = (found & truth).sum(axis=1)[wanted > 0]
    wanted = wanted[wanted > 0]
    return min(got.sum() / wanted.sum(), (got / wanted).mean()) if len(wanted) else 1.0


def found_links(graph: Graph, queries: np.ndarray, exact_x: np.ndarray, exact_q: np.ndarray, threshold: float,
                beam: int = SEARCH_BEAM, recall: float = RECALL, audited: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Bit matrix (queries x vectors) of verified links; beams widen until no query is cut off and the audit passes."""
    n = len(exact_x)
    out = np.zeros((len(queries), n), bool)
    seen, truth = audited or audit(exact_x, exact_q, threshold)
    todo = np.arange(len(queries))
    while True:
        while len(todo):
            wide = []
            step = max(1, min(BLOCK, (1 << 22) // beam))
            for s in range(0, len(todo), step):
                some = todo[s:s + step]
                ids, sims = graph.search(queries[some], min(beam, n))
                hit = (ids >= 0) & (sims >= threshold - 1e-4)
                r, c = np.nonzero(hit)
                a, b = some[r], ids[r, c]
                sure = _sure(exact_q, exact_x, a, b, threshold)
                out[a[sure], b[sure]] = True
                if beam < n:
                    wide.append(some[hit[:, -1]])
            todo = np.concatenate(wide) if wide else np.zeros(0, int)
            if len(todo):
                beam = min(2 * beam, n)
        if beam >= n or _recall(out[seen], truth[seen]) >= recall:
            out[seen] |= truth[seen]
            return out
        beam, todo = min(2 * beam, n), np.arange(len(queries))


def links_between(exact_x: np.ndarray, exact_q: np.ndarray, threshold: float) -> np.ndarray:
    """Bit matrix (queries x vectors) of links: by a graph over the vectors unless the audit has them all."""
    seen, truth = audit(exact_x, exact_q, threshold)
    if len(seen) == len(exact_q):
        return truth
    return found_links(Graph(exact_x), exact_q.astype(np.float32), exact_x, exact_q, threshold, audited=(seen, truth))


def shard_pair_links(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """Link counts and spanning forest of one pair of shards (``right`` None: within one)."""
    exact = [np.array(side["unit"].tolist(), np.float64) for side in (left, right) if side is not None]
    if right is None:
        links = links_between(exact[0], exact[0], threshold)
        links |= links.T
        np.fill_diagonal(links, False)
        ids, weights = left["vec_id"].to_numpy(np.int64), left["copies"].to_numpy(np.int64)
        counts = links @ weights
        a, b = np.nonzero(np.triu(links))
        a, b = _forest(len(ids), a, b)
        return _answer(ids, counts, ids[a], ids[b])
    x, y = exact
    links = links_between(y, x, threshold)
    links |= links_between(x, y, threshold).T
    ids = [side["vec_id"].to_numpy(np.int64) for side in (left, right)]
    weights = [side["copies"].to_numpy(np.int64) for side in (left, right)]
    counts = np.concatenate([links @ weights[1], links.T @ weights[0]])
    a, b = np.nonzero(links)
    both = np.concatenate(ids)
    a, b = _forest(len(both), a, b + len(ids[0]))
    return _answer(both, counts, both[a], both[b])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (place, root) from every place to the smallest place of its component, by label passing."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    places = np.nonzero(label != np.arange(n))[0]
    return places, label[places]


def _answer(ids: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    some = counts > 0
    return pd.DataFrame({
        "a": np.concatenate([ids[some], a]), "b": np.concatenate([ids[some], b]),
        "n": np.concatenate([counts[some], np.zeros(len(a), np.int64)]),
    })


def unit_vectors(embeddings: DataFrame, vector: str, label: str) -> DataFrame:
    """vec_id, label, unit (double) of the vectors that may link."""
    v = F.transform(vector, lambda e: e.cast("double"))
    good = F.size(vector) > 0
    for bad in (F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))),):
        good = good & ~bad
    rows = embeddings.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col("vec_id").isNotNull()).filter(good).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    # Scaled by the largest component first, so that neither tiny nor huge vectors lose their direction.
    peak = F.array_max(F.transform("v", lambda e: F.abs(e)))
    scaled = rows.withColumn("peak", peak).filter("peak > 0").select(
        "vec_id", "label", F.transform("v", lambda e: e / F.col("peak")).alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, e: a + e * e))
    return scaled.withColumn("norm", norm).select("vec_id", "label", F.transform("s", lambda e: e / F.col("norm")).alias("unit"))


def link_shards(units: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b, n: link counts (a = b, n) and forest edges (n = 0) over distinct unit vectors (vec_id, label, unit, copies)."""
    shards = units.groupBy("label", F.size("unit").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    placed = units.withColumn("dims", F.size("unit")).join(F.broadcast(shards) if shards.count() <= 100_000 else shards, ["label", "dims"])
    shard = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")
    # Every shard goes to each pair it takes part in: (i, j) with i <= j.
    dealt = placed.withColumn("shard", shard).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(
        "label", "dims", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "vec_id", "copies", "unit")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "copies"], kind="stable")
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        left, right = (group[group["shard"] == k] for k in (i, j))
        if i == j:
            return shard_pair_links(left, None, threshold)
        if not len(left) or not len(right):
            return _answer(*(np.zeros(0, np.int64),) * 4)
        return shard_pair_links(left, right, threshold)

    return dealt.groupBy("label", "dims", "i", "j").applyInPandas(run, "a long, b long, n long")


def near_duplicates(embeddings: DataFrame, vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
                    shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``."""
    # A node is a distinct content; it is known by the hash of its label and unit vector.
    units = cut_lineage(unit_vectors(embeddings, vector, label).withColumn("node", F.xxhash64("label", "unit")).distinct())
    same = units.groupBy("node", "label", "unit").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = cut_lineage(same)
    found = cut_lineage(link_shards(distinct.select(F.col("node").alias("vec_id"), "label", "unit", "copies"), threshold, shard_rows))
    firsts = distinct.select("node", "first", "copies")
    members = units.select("vec_id", "node").join(firsts, "node")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    links = members.join(counts, "node", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    stars = members.filter("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    edges = found.filter("n = 0").join(firsts.select(F.col("node").alias("a"), F.col("first").alias("x")), "a").join(
        firsts.select(F.col("node").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    nodes = components(edges.unionByName(stars)).withColumnRenamed("node", "vec_id")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    return rows.join(links, "vec_id", "left").join(nodes, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
