"""Spelling variants against comparing all pairs of words."""
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from shelfwatch.llm import spelling

LONG = "q" * 5_000
HUGE = "ab" * 150_000
TEXTS = [
    "example example Example exampel exxample examplé EXAMPLE, exampla exampla " * 3, None, "", " ", "x " * 10, LONG + " " + LONG + "x", LONG + "x " + LONG,
    "straße STRASSE strasse Straßen strassen straßen strassen", "ÀÉÎÕÜÿ×÷ ÀÉÎÕÜÿ×÷ àÉÎÕÜÿ×÷ ÀÉÎÕÜÿ×÷a", "foo_barbaz-barbazz barbazzz 日本example日本", HUGE + " " + HUGE + "c",
    "aaaaaaa aaaaaaaa aaaaaaaa aaaaaaa aaaaaaaaa", "letters letterz letters letterz lettersz lettersz letter", HUGE + "c " + HUGE, "İstanbul ſtrassen Kelvins",
]
IDS = [1, 2, 3, 4, 5, 6, None, 8, 9, 10, 11, 12, 12, 14, None]


def brute(rows, least=2):
    seen = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                seen[run] += 1
    words = {w: n for w, n in seen.items() if n >= least}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + (len(a) == len(b)):] == b[k + 1:]

    form, out = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = [n, len(others), words.get(form[w])]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def answers(df):
    rows = df.collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abé"), 8)) for _ in range(40)]
    noise = [" ".join(rng.choice(names, 200, p=np.arange(1, 41) ** 2.0 / sum(np.arange(1, 41) ** 2.0))) for _ in range(30)]
    return [*zip(IDS, TEXTS), *((100 + k, t) for k, t in enumerate(noise)), (7, TEXTS[0]), (7, TEXTS[0])]


@pytest.mark.parametrize("filter_bytes", [spelling.FILTER_BYTES, 60])
def test_equals_all_pairs(spark, rows, filter_bytes):
    docs = spark.createDataFrame([(*r, "w", 1, "h", 2) for r in rows], "doc_id long, text string, word string, n int, form string, h int")
    got = answers(spelling.spelling_variants(docs.repartition(3), filter_bytes=filter_bytes))
    assert got == brute(rows)
    assert any(v[0] for v in got.values())


def test_chain_of_forms(spark):
    text = " ".join(["chained"] * 2 + ["chainet"] * 25 + ["chaimet"] * 260 + ["chaimat"] * 2700)
    docs = spark.createDataFrame([(k, text) for k in range(1)], "doc_id long, text string")
    got = answers(spelling.spelling_variants(docs))
    assert got["chained"][:2] == ("chainet", "chaimat") and got == brute([(0, text)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0


def test_edits_hash_like_words():
    words = ["abcdefgh", "bbcdefgh", "abcdefg", "ébcdefgh", "abcdefghi"]
    filters = {s: np.full(64, ~np.uint64(0)) for s in range(7, 12)}
    alphabet = np.frombuffer(bytes(range(97, 105)) + "é".encode("latin-1"), np.uint8)
    letters = np.frombuffer(b"abcdefgh", np.uint8).reshape(1, -1)
    found = {int(h) for _, _, hs, _ in spelling.positive_edits(letters, filters, alphabet) for h in hs}
    near = spelling.word_hashes(words)
    assert {int(h) for h in near[1:4]} <= found and int(near[0]) not in found
