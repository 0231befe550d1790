"""Pair operators against brute force."""
import hashlib
import random

import numpy as np
import pytest

from shelfwatch.llm import hnsw, jaccard, substring
from shelfwatch.llm.fm_index import FmIndex

DOCS = "doc_id long, text string, n_chars long, h string, token int, label string, row int"


def words(rng, n, vocabulary=400):
    return [f"W{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies of every degree, shared passages, short and very long texts, nulls, repeated rows."""
    rng, texts = random.Random(5), []
    passage = words(rng, 70)
    for _ in range(12):
        base = words(rng, rng.randrange(6, 160))
        texts += [" ".join(base)] + [" ".join(near_copies(rng, base, rng.randrange(0, 12))) for _ in range(rng.randrange(12))]
    hot = words(rng, 130)
    texts += [" ".join(near_copies(rng, hot, rng.randrange(0, 5))) for _ in range(60)] + [" ".join(hot)] * 25
    texts += [" ".join(words(rng, rng.randrange(40)) + passage + words(rng, rng.randrange(40))) for _ in range(40)]
    texts += [None, "", " \n", "one", "ONE", "one two", "one\ttwo ", " ".join(words(rng, 9_000)), "a b c d e", "A b\x0bc d  e"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(3, texts[7]), (rows[5][0], rows[5][1]), (None, "one"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, len(t or ""), "x", 1, "y", 2) for i, t in corpus], DOCS).repartition(4)


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingle_set(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(corpus):
    sets, union = [(i, shingle_set(t)) for i, t in corpus], Union()
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    return sorted(((i, len(s), None if i is None else union.find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_jaccard_components(docs, corpus, limit):
    got = jaccard.near_duplicates(docs, limit=limit).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(corpus)


def test_jaccard_of_one_near_clique(spark):
    """A hot group with every degree of edits: the full pairing after the stars is needed and complete."""
    rng = random.Random(9)
    base = words(rng, 90, 10**6)
    corpus = [(i, " ".join(near_copies(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8])))) for i in range(1, 120)]
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect()), key=repr) == brute_components(corpus)


def test_filters_never_part_linked_sets():
    rng = np.random.default_rng(3)
    for _ in range(3_000):
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, int(rng.integers(0, 8)), dtype=np.uint64)]))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        want = 100 * both >= 80 * (len(x) + len(y) - both)
        assert jaccard.linked(x, y) == want
        if want:
            heads = [s[:jaccard.spare(len(s)) * 5 // 4 + 1] for s in (x, y)]
            for s, head in ((x, heads[0]), (y, heads[1])):
                assert len(np.intersect1d(*heads)) >= max(1, len(head) - jaccard.spare(len(s)) - 1)
            differ = np.bitwise_count(jaccard.parity(x) ^ jaccard.parity(y)).sum()
            assert differ <= len(x) + len(y) - 2 * both


def test_keep_one(docs, corpus):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    group = {i: c for i, _, c in brute_components(corpus)}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted({i for i in group if i is not None and group[i] == i})
    assert got.count(None) == 2


def test_fm_index_counts_and_windows():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sequences = [rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)) for _ in range(rng.integers(1, 8))]
        index = FmIndex(sequences)

        def count(p):
            return sum(int((s[i:i + len(p)] == p).all()) for s in sequences for i in range(len(s) - len(p) + 1))

        for _ in range(8):
            p = rng.integers(1, 5, rng.integers(1, 7))
            assert index.count(p) == count(p)
        for size in (2, 3, 7):
            found = list(zip(*index.matching_statistics(size)))
            assert len(found) == sum(max(0, len(s) - size + 1) for s in sequences)
            assert all(high - low == count(sequences[s][at:at + size]) for s, at, low, high in found)


def brute_removal(corpus, window=50):
    seen = {}
    for i, t in corpus:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k:k + window])
            seen[key] = min(seen.get(key, i), i)
    out = []
    for i, t in corpus:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if seen[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode() if any(gone) else t))
    return out


@pytest.mark.parametrize("least", [2_000, 3])
def test_substring_removal(docs, corpus, least, monkeypatch):
    monkeypatch.setattr(substring, "HOT_LEAST", least)
    monkeypatch.setattr(substring, "HOT_SHARE", 1_000 if least > 100 else 10**9)
    monkeypatch.setattr(substring, "SHARD_WORDS", 3_000)
    want = brute_removal(corpus)
    assert any(0 < r[2] < r[1] for r in want)
    got = substring.removal_report(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:4] for r in want), key=repr)


def test_anchors_of_a_text_that_repeats_in_itself_are_one_row(spark):
    """What a document repeats adds runs to its anchors, not rows to the join on them."""
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, " ".join([line] * 200)), (2, line), (3, None)], "doc_id long, text string")
    profiles = substring.profile(docs).collect()
    assert all(len(r["anchors"]) == len(set(r["anchors"])) <= 60 for r in profiles)
    found = {r["doc_id"]: sorted(tuple(p) for p in r["runs"]) for r in substring.candidate_windows(substring.profile(docs)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(found) == {1, 2}
    for doc_id, runs in found.items():
        h = substring.word_hashes(substring.split_words(texts[doc_id]))
        other = substring.word_hashes(substring.split_words(texts[3 - doc_id]))
        shared = set(substring.anchor_runs(other, 50, 25)[0].tolist())
        assert runs == [(a, b) for g, a, b in zip(*(x.tolist() for x in substring.anchor_runs(h, 50, 25))) if g in shared]
    removed = {r["doc_id"]: r["n_removed"] for r in substring.removal_report(docs).collect()}
    assert removed == {1: 0, 2: 60, 3: 0}


@pytest.mark.parametrize("pending", [10_000, 7])
def test_substring_line_repeated_in_one_text(spark, pending, monkeypatch):
    """A line over and over in many texts: a row per text and distinct window, not per window."""
    monkeypatch.setattr(substring, "HOT_LEAST", 3)
    monkeypatch.setattr(substring, "HOT_SHARE", 10**9)
    monkeypatch.setattr(substring, "PENDING_ROWS", pending)
    line = " ".join(f"w{i}" for i in range(12))
    corpus = [(i, f"own{i} " + f"{line} " * (20 + i % 7) + " ".join(f"t{i}x{j}" for j in range(60)) + f" {line}" * (i % 9)) for i in range(30)]
    corpus.append((7, corpus[7][1]))
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    want = brute_removal(corpus)
    assert sorted(map(tuple, substring.removal_report(docs).collect())) == sorted(r[:4] for r in want)
    runs = substring.candidate_windows(substring.profile(docs))
    found = substring.segments(substring._keyed(docs).join(runs, ["doc_id", "h"]).select("doc_id", "h", "text", "runs"))
    if pending > 7:
        assert found.count() < 31 * 40 < found.selectExpr("sum(size(starts))").first()[0]


def test_substring_texts(docs, corpus):
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns
    want = sorted(((r[0], r[4], len(r[4] or "")) for r in brute_removal(corpus)), key=repr)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=repr) == want


def test_empty_pair_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.near_duplicates(none).count() == 0
    assert jaccard.keep_one(none).count() == 0
    assert substring.removal_report(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng, rows = np.random.default_rng(4), []
    for label in (1, 2):
        for _ in range(40):
            centre = rng.standard_normal(16)
            rows += [(centre + rng.standard_normal(16) * s, label) for s in rng.choice([0.0, 0.1, 0.2, 0.3, 1.0], rng.integers(1, 8))]
        crowd = rng.standard_normal(16)
        rows += [(crowd + rng.standard_normal(16) * 0.05, label) for _ in range(80)] + [(crowd, label)] * 20
    rows = [(i, [float(v) for v in np.float32(x)], label) for i, (x, label) in enumerate(rows)]
    twin = rows[0][1]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, twin[:3] + [None] + twin[4:], 1), (1003, [float("nan")] + twin[1:], 1),
             (1004, [float("inf")] + twin[1:], 1), (1005, twin, None), (1006, [], 1), (1007, twin[:8], 1), (1008, [v * 1e-30 for v in twin], 1)]
    return rows + [rows[3], (1, rows[30][1], 1)]


def brute_vectors(rows, threshold=0.93):
    """Distinct contents per id; ids of several contents share links and component."""
    unit = []
    for i, v, label in rows:
        ok = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        unit.append((i, None if x is None else x / np.abs(x).max(), label))
    unit = [(i, None if x is None else x / np.linalg.norm(x), label) for i, x, label in unit]
    nodes, links, union = {}, {}, Union()
    for i, x, label in unit:
        if x is not None:
            nodes[(i, label, x.tobytes())] = x
    keys = list(nodes)
    for a, key in enumerate(keys):
        for other in keys[:a]:
            if key[1] == other[1] and len(nodes[key]) == len(nodes[other]) and float(nodes[key] @ nodes[other]) >= threshold:
                for k in (key, other):
                    links[k[0]] = links.get(k[0], 0) + 1
                union.join(key[0], other[0])
    return sorted((i, links.get(i, 0), union.find(i), union.find(i) == i) for i, _, _ in rows)


@pytest.mark.parametrize("shard_rows", [8_192, 60])
def test_vector_links(spark, vectors, shard_rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], "vec_id long, embedding array<float>, label int, unit string, a int")
    got = sorted(map(tuple, hnsw.near_duplicates(df, shard_rows=shard_rows).collect()))
    want = brute_vectors(vectors)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g != w for g, w in zip(got, want)) <= 4


def test_graph_recall():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph(x)
    ids, _ = graph.search(x[:200].astype(np.float32), 64)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, best)]) > 0.9
    found = hnsw.found_links(graph, x.astype(np.float32), x, x, 0.75)
    truth = x @ x.T >= 0.75
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.9 * truth.sum()


def sparse_pairs(n, dims, pairs, seed=9):
    """Unit vectors at random, of which the last ``pairs`` are near copies of the first."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((pairs, dims))
    x[n - pairs:] = x[:pairs] + 0.3 * off / np.linalg.norm(off, axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("within", [False, True])
def test_audit_needs_evidence(within):
    x = sparse_pairs(3_000, 48, 60)
    y, q = (x, x) if within else (x[1_500:], x[:1_500])
    truth = q @ y.T >= 0.93
    assert truth.sum() - within * len(q) == (120 if within else 60)
    if within:
        np.fill_diagonal(truth, False)
    found = hnsw.found_links(hnsw.Graph(y, m=2, beam=2), q.astype(np.float32), y, q, 0.93, beam=1)  # a graph that loses links
    assert (found & truth).sum() >= 0.98 * truth.sum()


def test_recall_of_sparse_pairs_across_shards(spark):
    x = sparse_pairs(4_000, 32, 200)
    truth = x @ x.T >= 0.93
    np.fill_diagonal(truth, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = {r.vec_id: r.n_links for r in hnsw.near_duplicates(df, shard_rows=700).collect()}
    assert truth.sum() >= 400 and sum(links.values()) >= 0.98 * truth.sum()
    assert all(links[i] <= w for i, w in enumerate(truth.sum(axis=1)))
