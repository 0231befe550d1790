"""Filters, archives and the pipeline against brute force."""
import base64
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import urljoin

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from shelfwatch.llm import decontaminate, quality, sql, url_rules, warc
from shelfwatch.llm.common import open_folder
from shelfwatch.llm.queries import QUERIES, SQL, URL_RULES
from shelfwatch.session import scratch_path
from test_pairs import brute_components, brute_removal

PAGES = "page_id long, url string, html string, host string, rule string, own string, payload string, sha1 string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], PAGES)


# --- urls ---------------------------------------------------------------------

LINK = '<html><link rel="canonical" href="{}"></html>'
URLS = [
    (1, "http://a.example.com/en/x", None), (2, "https://www.example.com/en/x", ""), (3, "ftp://B.NET/es/1?q#f", ""),
    (4, "https://b.net/de/1", LINK.format("https://b.net/es/9")), (5, "https://b.net/de/2", LINK.format("//b.net/de/1")),
    (6, "https://b.net/de/3", '<META http-equiv=refresh content="0;URL=/de/2">'), (7, "https://b.net/de/4", ""),
    (8, "https://b.com/x", LINK.format("https://b.net/es/9")), (9, None, LINK.format("https://b.net/es/9")), (10, "b.net/es/", ""),
    (11, "https://b.net/es", ""), (12, "HTTP://b.net/es/?x=1", ""), (12, "HTTP://b.net/es/?x=1", ""), (None, "https://notnet/es/", ""),
    (13, "https://c.org/a?utm_source=x", ""), (14, "http://c.org/a/", LINK.format("https://c.net/fr/")), (15, "", ""), (16, "x\n://net/fr/\n", None),
    (17, "https://c.org/a#" + "y" * 50_000, ""),
]


def brute_verdicts(rows, edges):
    def parse(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return (m[1].translate(low), m[2]) if m else ("", "")

    def rule(u):
        host, path = parse(u)
        fit = [(r.host + r.path, r.verdict) for r in URL_RULES
               if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda x: len(x[0]), default=(None, None))

    group = {}
    for a, b in edges:
        old = group.get(a, {a}) | group.get(b, {b})
        for u in old:
            group[u] = old
    out = []
    for i, u, _ in rows:
        text, own = rule(u)
        blocked = any(rule(x)[1] == "block" for x in group.get(u, ()))
        out.append((i, *parse(u), text, own or ("block" if blocked else "allow")))
    return sorted(out, key=repr)


def test_url_verdicts(spark):
    pages = pages_of(spark, URLS)
    edges = url_rules.link_edges(pages)
    listed = [tuple(r) for r in edges.collect()]
    assert ("https://b.net/de/2", "https://b.net/de/1") in listed and ("https://b.net/de/3", "https://b.net/de/2") in listed
    assert ("http://c.org/a/", "https://c.org/a") in listed and ("https://c.org/a?utm_source=x", "https://c.org/a") in listed
    got = sorted((tuple(r) for r in url_rules.judge(pages, edges, URL_RULES).collect()), key=repr)
    assert got == brute_verdicts(URLS, listed)
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[k] for k in (4, 5, 6, 7, 8, 9, 11, 13, 14)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "block"]


BASES = ["https://b.net/de/sub/p.html", "https://b.net/de/sub/", "http://b.net", "https://b.net?q=/x/y", "https://b.net/a/b/c?x#/y/z"]
TARGETS = ["index.html", "../es/9", "../../../es/9", "./es/./9", "?p=2&x=3", "x/..", "x/.", "..", ".", "/de/../es/9?u=../v#w", "//net/es/x",
           "a/../../b/", "http://b.net/es/1", "a..b/..c"]


def test_targets_are_resolved(spark):
    expected = {(b, t): urljoin(b, t) for b in BASES for t in TARGETS}
    expected |= {(BASES[0], t): None for t in ("#top", "", "mailto:a@b.net")}
    # Empty segments are segments (urljoin drops them).
    expected |= {("https://b.net/a//b/c", "x"): "https://b.net/a//b/x", ("https://b.net/c", "/x//../y"): "https://b.net/x/y"}
    df = spark.createDataFrame(list(expected), "u string, t string")
    got = df.select("u", "t", url_rules.resolved(F.col("u"), F.col("t"))).collect()
    assert {(r[0], r[1]): r[2] for r in got} == expected


def test_aliases_by_any_spelling(spark):
    """The SQL knows the same links; each of the pages 1 to 7 reaches a blocked page in another way."""
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "https://b.net/de/1", LINK.format("../es/9")), (2, "https://b.net/de/a/2?x", refresh.format("../../es/index.html")),
        (3, "https://b.net/de/3", LINK.format("https://b.net/es/?x=1&amp;y=2")), (4, "https://b.net/de/4", LINK.format("http://b.net/es/p/?utm_source=k")),
        (5, "https://b.org/p", ""), (6, "https://b.org/es/6", LINK.format("http://b.org/p/?utm_source=k#f")),
        (7, "https://b.org/d/7", LINK.format("?p=2")), (8, "https://b.org/d/7?p=2", LINK.format("//x.net/fr/./a")),
        (9, "https://b.org/es/6", LINK.format("http://B.net/es/z")), (10, "https://b.org/d/10", LINK.format("mailto:x@b.net")), (11, None, None),
        (12, "https://b.org/d/12", LINK.format("#es")), (13, "https://b.org/", refresh.format("x/../../y")), (14, "https://b.org/y/", ""),
    ]
    pages = pages_of(spark, rows)
    edges = url_rules.link_edges(pages)
    listed = [tuple(r) for r in edges.collect()]
    assert {("https://b.org/", "https://b.org/y"), ("https://b.org/y/", "https://b.org/y"), ("https://b.net/de/3", "https://b.net/es/?x=1&y=2")} <= set(listed)
    got = sorted((tuple(r) for r in url_rules.judge(pages, edges, URL_RULES).collect()), key=repr)
    assert got == brute_verdicts(rows, listed)
    assert {r[0] for r in got if r[4] == "block"} == set(range(1, 10))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    columns = "page_id, host, path, rule, verdict"
    assert sorted(con.execute(f"SELECT {columns} FROM ({sql.URL_FILTERS})").fetchall(), key=repr) == got


def test_no_pages(spark):
    none = pages_of(spark, [])
    assert url_rules.judge(none, url_rules.link_edges(none), URL_RULES).count() == 0
    source, target = scratch_path(spark, "w"), scratch_path(spark, "w")
    files = warc.normalise_archives(spark, warc.write_archives(warc.plan_records(none), source), source, target)
    assert warc.read_archives(files, target).count() == 0


# --- benchmark passages ---------------------------------------------------------


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(2)

    def text(n):
        return [f"w{rng.randrange(900)}" for _ in range(n)]

    items = [(i, " ".join(text(rng.choice([8, 20, 40])))) for i in range(12)] + [(50, None), (51, ""), (52, "a b")]
    docs, dirty = [], set()
    for k in range(150):
        w = text(rng.randrange(0, 120))
        if k % 3 == 0:
            part = items[rng.randrange(12)][1].split()
            for s in range(rng.randrange(3), len(part), max(7, 8 * (len(part) == 8))):
                part[s] = "swap"
            w[len(w) // 2:len(w) // 2] = part
            dirty.add(k)
        docs.append((k, " ".join(w).upper() if k % 2 else "\t".join(w) + "\n"))
    docs += [(900, None), (901, ""), (902, "a b"), (None, items[1][1]), (0, docs[0][1]), (903, " ".join(text(20_000)) + " " + items[2][1])]
    return docs, items, dirty | {None, 903}


SEEDED = "doc_id long, text string, words string, at int, item_id int, seed0 string, _dirty string"


@pytest.mark.parametrize("bound", [10**6, 0])
def test_leaks_are_found(spark, leaks, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
    docs, items, dirty = leaks
    table = spark.createDataFrame([(*d, "x", 1, 2, "y", "z") for d in docs], SEEDED)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.overlaps(table, bench).collect()
    assert {r.doc_id for r in found} == dirty
    for r in found[:20]:
        doc = next((t or "").lower().split() for i, t in docs if i == r.doc_id)
        item = dict(items)[r.item_id].split()
        span = doc[r.first_word:r.last_word + 1]
        shift = max(sum(a == b for a, b in zip(span, item[k:])) for k in range(len(item)))
        assert r.n_words == len(span) and shift >= 0.7 * len(span)
    clean = decontaminate.decontaminate(table, bench)
    assert clean.columns == table.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, _ in docs if i not in dirty), key=repr)


def test_masks_miss_no_pattern():
    assert decontaminate.missed() == []
    assert (15, (1, 6, 11)) in decontaminate.missed(("111111", "11011011", "10101010101"))


def brute_overlaps(docs, items):
    """Every window of every alignment, without seeds: doc_id, item_id, first and last word."""
    out = []
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            b = item.lower().split()
            size = min(15, len(b))
            for shift in range(1 - len(b), len(w)) if size >= 6 else ():
                good = [s for s in range(max(0, -shift), min(len(b), len(w) - shift) - size + 1)
                        if 5 * sum(w[s + shift + k] == b[s + k] for k in range(size)) >= 4 * size]
                if good:
                    out.append((d, i, good[0] + shift, good[-1] + size - 1 + shift))
    return sorted(out)


def test_substitutions_are_found(spark):
    rng = random.Random(5)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (5, 6, 7, 8, 9, 10, 15, 16, 60)]
    items.append((100, " ".join(f"c{rng.randrange(3)}" for _ in range(30))))
    swaps = []
    for n, item in items:
        w = item.split()
        few = [{k} for k in range(n)] if n < 10 else [{0, 5, 10}, {1, 6, 11}, {3, 7, 11}, {0, 5}, {4, 9}, {1, 2, 3, 4}]
        few += [set(range(k, n, 5)) for k in range(5)] + [set(rng.sample(range(len(w)), len(w) // 5)) for _ in range(20)]
        swaps += [["swap" if k in bad else x for k, x in enumerate(w)] for bad in few]
    docs = [(k, " ".join(["a", "b"] * (k % 3) + w + ["z"] * (k % 2))) for k, w in enumerate(swaps)]
    docs += [(1000 + k, " ".join(f"c{rng.randrange(3)}" for _ in range(40))) for k in range(40)]
    want = brute_overlaps(docs, items)
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 150 and sorted(tuple(r)[:4] for r in found.collect()) == want


def test_rows_of_an_id_are_judged_by_their_texts(spark):
    item = " ".join(f"i{k}" for k in range(20))
    docs = [(None, "a " + item), (None, "clean words"), (None, None), (7, item), (7, "other clean words"), (8, item)]
    clean = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted([docs[1], docs[2], docs[4]], key=repr)


def test_overlaps_stay_native(spark, leaks):
    docs, items, _ = leaks
    df = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_nothing_to_decontaminate(spark, leaks):
    docs, items, _ = leaks
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.overlaps(table.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(table, bench.limit(0)).count() == len(docs)


def test_sql_knows_no_seeds(spark, leaks):
    import duckdb
    import pandas as pd

    docs, items, _ = leaks
    item = " ".join(f"t{k}" for k in range(60))
    fifth = " ".join("other" if k % 5 == 4 else f"t{k}" for k in range(60))
    docs = [d for d in docs if d[0] is not None and d[0] < 900] + [(1_000, fifth), (1_001, "lead " + fifth), (1_002, " ".join(f"t{k}" if k % 2 else "o" for k in range(60)))]
    items = [*items, (60, item)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    want = sorted(con.execute(sql.DECONTAMINATION).fetchall())
    found = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == want
    assert (1_001, 60, 1, 60, 60) in want and 1_002 not in {w[0] for w in want}


def test_long_texts_on_the_shuffled_side(spark, leaks, monkeypatch):
    """Shuffled positions hold no text, so the bytes follow the length of a text."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    text = " ".join(f"w{k % 977}" for k in range(60_000)) + " " + leaks[1][2][1]
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame(leaks[1], "item_id long, text string"))
    assert {(r.doc_id, r.last_word) for r in found.collect() if r.item_id == 2 and r.last_word >= 60_000} == {
        (i, 60_000 + len(leaks[1][2][1].split()) - 1) for i in (1, None)}


@pytest.mark.parametrize("bound", [10**6, 0])
def test_items_of_equal_words_are_compared_once(spark, leaks, bound, monkeypatch):
    """A seed is a few numbers whatever the length of its text, and copies of an item add none."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", bound)
    docs, items, _ = leaks
    long = " ".join(f"l{k}" for k in range(4_000))
    base = [*items[:6], (70, long), (71, items[1][1] + " " + items[2][1]), (71, items[2][1])]
    copies = [(i + 1_000 * c, t.upper() if c % 2 else t) for c in range(1, 5) for i, t in base] + [(None, items[0][1])]
    corpus = spark.createDataFrame([*docs, (904, "x " + long)], "doc_id long, text string")
    one, many = (spark.createDataFrame(x, "item_id long, text string") for x in (base, base + copies))
    seeds = [decontaminate.benchmark_seeds(decontaminate.benchmark_texts(x)[0]) for x in (one, many)]
    assert dict(seeds[0].dtypes) == {"mask": "int", "seed": "bigint", "text": "bigint", "place": "int"}
    assert seeds[0].count() == seeds[1].count()
    of_one = {tuple(r) for r in decontaminate.overlaps(corpus, one).collect()}
    of_many = [tuple(r) for r in decontaminate.overlaps(corpus, many).collect()]
    want = [(d, i + 1_000 * c, *rest) for d, i, *rest in of_one for c in range(5)] + [(d, None, *rest) for d, i, *rest in of_one if i == 0]
    assert sorted(of_many, key=repr) == sorted(want, key=repr) and (904, 70, 1, 4_000, 4_000) in of_one


# --- quality ---------------------------------------------------------------------


def test_scores_equal_a_plain_recomputation(spark):
    """Features, projection and vote word by word and pair by pair, from the model's own numbers."""
    import math
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.limit(40).collect()} | {-1: None, -2: "", -3: "x" * 300 + " 99!!--  Ab AB ab"}
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_documents(table, model).collect()}

    def plain_shape(word):
        out, k = "", 0
        while k < len(word):
            kind = lambda c: "0" if c.isdecimal() else "a" if re.match(r"[^\W\d_]", c) else c
            end = k
            while end < len(word) and kind(word[end]) == kind(word[k]):
                end += 1
            run = word[k:end]
            out += "0" if kind(run[0]) == "0" else ("w" if run != run.upper() else "W") if kind(run[0]) == "a" else run[0] + "+" * (len(run) > 1)
            k = end
        return out

    for i, text in rows.items():
        text = text or ""
        counts = [0.0] * 1_536
        for word in text.split():
            counts[zlib.crc32(word.lower().encode()) % 1_024] += 1
            counts[1_024 + zlib.crc32(plain_shape(word).encode()) % 512] += 1
        first = [math.log1p(c) * float(w) for c, w in zip(counts[:1_024], model.idf)]
        second = [math.sqrt(c * float(w)) for c, w in zip(counts[1_024:], model.idf[1_024:])]
        norm = [math.sqrt(sum(x * x for x in part)) or 1.0 for part in (first, second)]
        whole = (np.array(quality.measures(text, text.split())) - model.centre) / model.spread / 4
        x = np.array([0.5 * v / norm[0] for v in first] + [v / norm[1] for v in second] + whole.tolist())
        latent = x @ model.basis.astype(np.float64)
        latent /= max(np.linalg.norm(latent), 1e-9)
        near = sorted(((-round(float(latent @ v), 5), k) for k, v in enumerate(model.vectors.astype(np.float64))))[:15]
        weight = [max(-s, 1e-6) ** 4 for s, _ in near]
        assert abs(got[i] - sum(w * model.labels[k] for w, (_, k) in zip(weight, near)) / sum(weight)) < 0.02


def test_shapes_of_whole_words():
    shapes = {w: quality.shape(w) for w in ("hello", "Hello", "HELLO", "99!!", "a" * 40 + "99!!", "x_y", "--A1b", "日本")}
    assert shapes == {"hello": "w", "Hello": "w", "HELLO": "W", "99!!": "0!+", "a" * 40 + "99!!": "w0!+", "x_y": "w_w", "--A1b": "-+W0w", "日本": "W"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score_documents(docs, model).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(bad) < 0.2


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert len(model.labels) == 0 and model.score(["x", ""]).tolist() == [0.5, 0.5]


def test_scores_of_odd_rows(spark):
    rows = [(1, "Good words are here, all of them.", 1), (3, "BUY!!! $$$ BUY!!! $$$", 0), (4, None, 1), (5, "", 0), (6, "y" * 200_000, 1), (6, "z", 1), (None, "q", 0)]
    docs = spark.createDataFrame([(*r, 0.1, 9) for r in rows], "doc_id long, text string, quality int, score double, predicted int")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (3, 5)], "doc_id long, quality int")
    out = quality.score_documents(docs, quality.train(docs.select("doc_id", "text"), labels)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert quality.score_documents(docs.limit(0), quality.fit([], [])).count() == 0


# --- archives ---------------------------------------------------------------------


def test_archives(spark):
    html = ["<p>a</p>", "<p>a</p>", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n", "", None, "é" * 300_000, "<p>a</p>", "b"]
    rows = [(10 - i, f"http://x/{i}\r\nEvil: 1", h) for i, h in enumerate(html)] + [(4, "http://x/again", "<p>a</p>"), (None, None, "b"), (None, "u", "alone")]
    pages = pages_of(spark, rows).repartition(3)
    source, target = scratch_path(spark, "w"), scratch_path(spark, "w")
    streams = warc.write_archives(warc.plan_records(pages), source)
    archives = warc.normalise_archives(spark, streams, source, target)
    got = warc.read_archives(archives, target).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = first.get(h or "") not in (None, i)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                     first[h or ""] if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    store, root = open_folder(target)
    for r in got:  # each record is a gzip member of its own
        with store.open_input_file(f"{root}/{r.file}") as file:
            file.seek(r.offset)
            record = gzip.decompress(file.read(r.length))
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n") and b"\nEvil" not in record
    assert sum(r.records for r in archives.collect()) == len(rows)


def test_small_payloads_are_responses(spark):
    pages = pages_of(spark, [(1, "u", "a"), (2, "u", "a"), (3, "u", "long"), (4, "u", "long")])
    kinds = {r.page_id: r.refers_to for r in warc.plan_records(pages, min_bytes=2).collect()}
    assert kinds == {1: None, 2: None, 3: None, 4: 3}


def test_inflate_takes_any_number_of_members():
    from io import BytesIO

    data = b"x" * 5_000_000
    assert b"".join(warc.inflate(BytesIO(gzip.compress(data) + gzip.compress(b"y")))) == data + b"y"


# --- queries and pipeline ----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    from checks.compare import compare, connect

    assert compare(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) is None


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against brute force on that very input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, None), (None, "x y", "en", "s", 3)], docs.schema))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SMALL))
        assert docs.columns == columns
        kept[name] = (before, docs.collect())
    before, after = kept["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    stays = {r.doc_id for r in after}
    assert np.mean([(i in stays) == (labels[i] == 1) for i in (r.doc_id for r in before) if i in labels]) > 0.95
    before, after = kept["near_copies"]
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before]) if i is None or i == c}
    assert {r.doc_id for r in after} == want
    before, after = kept["repeats"]
    want = {r[0]: r[4] for r in brute_removal([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want
    before, after = kept["benchmark_passages"]
    grams = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = r.text.lower().split()
        grams |= {tuple(w[k:k + 13]) for k in range(len(w) - 12)}
    left = {r.doc_id for r in after}
    for r in before:
        w = (r.text or "").lower().split()
        assert (r.doc_id not in left) == any(tuple(w[k:k + 13]) in grams for k in range(len(w) - 12))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}


def test_anchors_of_a_shared_passage_are_counted_in_the_task(monkeypatch):
    import pyarrow as pa

    from shelfwatch.llm import substring

    passage = " ".join(f"w{k}" for k in range(120))
    texts = [f"{passage} own{d} {passage}" for d in range(40)]
    runs = [[{"first": 0, "last": len(t.split()) - substring.WINDOW}] for t in texts]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "h": list(range(40)), "text": texts, "runs": runs})
    every = [int(a) for t, r in zip(texts, runs) for a in substring._wanted(substring.word_hashes(substring.split_words(t)), r, substring.WINDOW)[0].view("int64")]
    for limit in (substring.PENDING_ANCHORS, 5):
        monkeypatch.setattr(substring, "PENDING_ANCHORS", limit)
        out = [(a, n) for batch in substring.anchor_counts(iter([rows, rows])) for a, n in zip(*(c.to_pylist() for c in batch.columns))]
        summed = {a: sum(n for b, n in out if b == a) for a, _ in out}
        assert summed == {a: 2 * every.count(a) for a in every}
        if limit > 5:
            assert len(out) == len(summed) < len(every) / 20
