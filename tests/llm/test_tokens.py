"""Token operators against the tokenizers' own libraries."""
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwatch.llm import byte_bpe, token_counts, token_files
from shelfwatch.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "Anlong wörds, 12 of-them! " * 12_000
TEXTS = [None, "", " ", "\n", "a", "Hello  world\n\n 12x", "é́▁▁ ​ x ", LONG, "same", "same", "x" * 5_000,
         "<s> </s> <|endoftext|> <unk>", "日本語 テキスト 😀"]
SCHEMA = "doc_id long, text string, n_tokens string, ids string, h int, words int, part string"
PARTS = st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "é", "'s", "the", "ing", "日本", "\x0b", "▁", "<s>", "😀", "́",
                                  "\x00", "12", ".", "\x1c", "\x85", "\xa0", "!!!", "<|endoftext|>"]), max_size=14)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 4 else i, t, "x", "y", 1, 2, "z") for i, t in enumerate(TEXTS)] + [(9, "same", "x", "y", 1, 2, "z")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_word_wise_counts_equal_the_library(parts):
    text = "".join(parts)
    assert token_counts.count_tokens(text, {}, PIECES) == len(token_counts.model(PIECES).encode(text))


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_word_wise_ids_equal_the_library(parts):
    coder = token_files.encoder(WORDS)
    assert coder.encode("".join(parts)).tolist() == coder.tokenizer.encode("".join(parts), add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(PARTS, PARTS, st.data())
def test_prefix_tables_equal_the_library(tik, parts, more, data):
    bpe, text, put = byte_bpe.encoder(BPE, public_tokenizers.PATTERN), "".join(parts), "".join(more)
    assert list(bpe.encode(text)) == tik.encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()
    start = data.draw(st.integers(0, len(text)))
    end = data.draw(st.integers(start, len(text)))
    old = bpe.start(text)
    assert old.ids(bpe) == tik.encode_ordinary(text)
    assert bpe.append(old, put).ids(bpe) == tik.encode_ordinary(text + put)
    edited = bpe.edit(old, start, end, put)
    assert edited.ids(bpe) == tik.encode_ordinary(text[:start] + put + text[end:])
    assert edited == bpe.start(edited.text)


def test_an_edit_stops_where_the_tables_agree(tik):
    bpe = byte_bpe.encoder(BPE, public_tokenizers.PATTERN)
    word = "intersubjectivity" * 2_000
    old = bpe.start("some words before " + word + " and some behind")
    looked, seen = bpe._apart, []
    bpe._apart = type("Counted", (), {"__getitem__": lambda self, pair: seen.append(pair) or looked[pair]})()
    try:
        edited = bpe.edit(old, 1_000, 1_003, "xyz")
    finally:
        bpe._apart = looked
    assert edited.ids(bpe) == tik.encode_ordinary(edited.text) and len(seen) < 2_000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinorst", min_size=2, max_size=40))
def test_borders_stand_where_merging_leaves_them(tik, word):
    bpe = byte_bpe.encoder(BPE, public_tokenizers.PATTERN)
    assert bpe.encode(word).tolist() == tik.encode_ordinary(word)


def test_append_keeps_the_known_prefix():
    bpe = byte_bpe.encoder(BPE, public_tokenizers.PATTERN)
    table = bpe.last_tokens(b" internat")
    assert bpe.last_tokens(b" internationalisation")[:len(table)] == table
    assert bpe.last_tokens(b" internationalisation", list(table)) == bpe.last_tokens(b" internationalisation")


def test_counts(docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(docs, PIECES, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = []
    for r in docs.collect():
        t = r.text or ""
        n = len(sp.encode(t))
        want.append((r.doc_id, len(t.encode()), n, n > 100))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_round_trip(docs, tik):
    got = byte_bpe.round_trip(docs, BPE, public_tokenizers.PATTERN, with_ids=True)
    want = []
    for r in docs.collect():
        ids = tik.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    encoded = byte_bpe.encode_documents(docs, BPE, public_tokenizers.PATTERN)
    back = byte_bpe.decode_documents(encoded, BPE, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r.text or "").encode() for r in docs.collect())


def test_token_files(spark, docs):
    written = token_files.write_token_files(docs, WORDS, 2, scratch_path(spark, "t"))
    tok, start, want = Tokenizer.from_file(WORDS), 0, []
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = sorted(map(tuple, token_files.read_token_files(written).collect()), key=lambda r: r[1])
    assert got == want
    places = [(r.part, r.place) for r in sorted(written.index.collect(), key=lambda r: (r.part, r.place))]
    ids = [r.doc_id for r in sorted(written.index.collect(), key=lambda r: (r.part, r.place))]
    assert len(set(places)) == len(places) and ids == [r.doc_id for r in rows]
    assert {r.dictionary_sha256 for r in written.index.collect()} == {written.dictionary_sha256}


def test_a_wrong_dictionary_is_noticed(spark, docs):
    written = token_files.write_token_files(docs, WORDS, 2, scratch_path(spark, "t"))
    forged = token_files.TokenFiles(written.folder, written.index, "0" * 64, written.id_bytes)
    with pytest.raises(Exception, match="dictionary is not the one"):
        token_files.read_token_files(forged).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(none, PIECES).count() == 0
    assert byte_bpe.round_trip(none, BPE, public_tokenizers.PATTERN).count() == 0
    written = token_files.write_token_files(none, WORDS, 2, scratch_path(spark, "t"))
    assert token_files.read_token_files(written).count() == 0
