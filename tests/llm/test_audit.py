"""Filter audit against taking every document through every order."""
from collections import Counter
from itertools import permutations

import pytest

from shelfwatch.llm.filter_audit import filter_audit, lehmer_rank, mask_edges, orders

PROSE = " ".join(f"word{i}" for i in range(250))
DULL = "same old words " * 90
ROWS = [  # doc_id, text, lang
    (1, PROSE, "en"), (2, PROSE, "de"), (3, PROSE, "en"), (3, PROSE, "en"), (4, DULL, "en"), (5, DULL + "&", None), (6, "", "en"),
    (7, None, "de"), (8, "ABC def", "en"), (9, "ABC def", ""), (None, PROSE, "en"), (None, None, None), (10, DULL.upper() + "#", "de"),
    (11, "x" * 300_000, "fr"), (12, " \x0b\n", "fr"), (13, PROSE + " ÄÖÜ", "fr"), (14, DULL, "en"), (4, DULL, "en"), (15, "a\x1cb\xa0c", "fr"),
]
LABELS = [(1, 1, 0), (3, 1, 0), (4, 0, 1), (4, 1, None), (5, 1, 1), (None, 1, 1), (9, None, None), (14, 1, 0), (14, 1, 0)]
SCHEMA = "doc_id long, text string, lang string"


def brute(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *f in labels if f[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
                 "E": i is not None and first[text] < i}
        docs.append((lang or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out, total = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                out[part, order, step] = [
                    len(left) - len(here), len(here), sum(f in d[1] for d in gone),
                    sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in here), sum(d[3] for d in here)]
                total[part, f] += len(here)
                left, gone = [d for d in left if f not in d[1]], gone + here
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", 1, 2, True, "y") for r in ROWS],
                                 SCHEMA + ", part string, mask int, good long, labelled boolean, n string").repartition(4)
    labels = spark.createDataFrame([(*r, 3, "z") for r in LABELS], "doc_id long, quality int, toxic int, good int, part string")
    rows = filter_audit(docs, labels).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(rows) == len(got) and got == brute(ROWS, LABELS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit(docs.limit(0), labels).count() == 0
    unlabelled = filter_audit(docs, labels.limit(0))
    assert unlabelled.count() == 4 * 600 and unlabelled.filter("good_lost + toxic_lost > 0").count() == 0


@pytest.mark.parametrize("mask", [1, 6, 31])
def test_intervals_cover_each_order_once(mask):
    ranks = orders()
    steps = [0] * 120
    for m, step, rank, sign in mask_edges():
        if m == mask:
            for k in range(rank, 120):
                steps[k] += sign * step
    failed = {f for k, f in enumerate("ABCDE") if mask >> k & 1}
    assert steps == [min(o.index(f) for f in failed) + 1 for o in ranks]
    assert [lehmer_rank(o) for o in ranks] == list(range(120))
