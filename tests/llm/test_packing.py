"""Packing: ids against the tokenizer's library, placement against plain first fit."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwatch.llm import packing
from test_tokens import PARTS, TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TIES = ["\n\n", "a\n\nb", "a\n\n\nb", "a\n\n b", "a\n b", "a \nb", "\n a", "\na\n", "a\n\n", " a", "  a", "a\tb \tc", "a\n\tb", "x <|endoftext|>y",
        "'s 're\n'll", "a\x85 b", "\x00a \x00"]


def library(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_ids_are_the_librarys(parts):
    coder, text = packing.encoder(PATH), "".join(parts)
    assert coder.by_rank is not None
    assert np.frombuffer(coder.encode(text), coder.width).tolist() == library(text)


def test_white_space_and_special_strings():
    coder = packing.encoder(PATH)
    for text in [*TIES, *filter(None, TEXTS)]:
        assert np.frombuffer(coder.encode(text), coder.width).tolist() == library(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes, rooms, want = sorted(sizes, reverse=True), [], []
    for size in sizes:
        at = next((k for k, room in enumerate(rooms) if room >= size), len(rooms))
        if at == len(rooms):
            rooms.append(64)
        want.append((at, 64 - rooms[at]))
        rooms[at] -= size
    where, offset = packing.first_fit_decreasing(np.array(sizes, np.int64), 64)
    assert list(zip(where.tolist(), offset.tolist())) == want


def check(rows, docs, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) <= capacity and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    got = sorted((repr(i), r["start"], r["doc_tokens"], tuple(r["ids"])) for i, rs in by_doc.items() for r in rs)
    want = []
    for i, text in docs:
        ids = library(text) + [1]
        want += [(repr(i), at, len(ids), tuple(ids[at:at + capacity])) for at in range(0, len(ids), capacity)]
    assert got == sorted(want)


def test_every_id_in_one_piece(spark):
    docs = [(None if k % 5 == 4 else k % 9, t) for k, t in enumerate(TEXTS + TIES)]
    table = spark.createDataFrame([(*d, 1, "x", 2, [3]) for d in docs], "doc_id long, text string, piece int, start string, length int, ids array<int>")
    check(packing.pack_documents(table.repartition(3), PATH, 1, with_ids=True).collect(), docs, 2048)
    small = packing.pack_documents(table.repartition(3), PATH, 1, capacity=16, group=40, with_ids=True).cache()
    check(small.collect(), docs, 16)
    assert small.select("sequence_id").distinct().count() > 40
    figures = packing.padding(small, 16).first()
    assert figures["tokens"] == sum(len(library(t)) + 1 for _, t in docs)
    assert packing.pack_documents(table.limit(0), PATH, 1).count() == 0


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    figures = packing.padding(packing.pack_documents(docs, PATH, 1)).first()
    assert figures["padded"] < 0.05 * figures["tokens"]
