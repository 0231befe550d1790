"""What Python workers hold: caches and the fit of the quality model."""
import tracemalloc

import public_tokenizers

from shelfwatch.llm import quality, token_files
from shelfwatch.llm.common import Memo


def test_fitting_holds_the_counts_and_little_more_than_twice():
    texts = [f"word{i % 97} Text {i % 13}, more of it {i}" for i in range(quality.SAMPLE)]
    labels = [i % 2 for i in range(len(texts))]
    quality.fit(texts[:8], labels[:8])
    counts = len(texts) * (quality.WORD_DIMS + quality.SHAPE_DIMS) * 4
    tracemalloc.start()
    try:
        quality.fit(texts, labels)
        assert tracemalloc.get_traced_memory()[1] < 3 * counts
    finally:
        tracemalloc.stop()


def test_a_full_cache_keeps_what_is_asked_for_again():
    made = []
    memo = Memo(lambda key: made.append(key) or -key, limit=100)
    for i in range(1_000):
        assert memo[i] == -i and memo[-1] == 1
        assert len(memo) + len(memo.old) <= 100
    assert made.count(-1) == 1 and len(made) == 1_001


def test_words_that_differ_in_marks_and_case_share_their_pieces():
    coder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    piece = coder.pieces.make
    coder.pieces.make = lambda p: asked.append(p) or piece(p)
    coder.pieces.clear()
    coder.pieces.old.clear()
    text = "Word word, WORD. (word) wörd\tWörd; 'S it's 12 <| x"
    plain = text.replace("<|", "<")
    assert coder.encode(plain).tolist() == coder.tokenizer.encode(plain, add_special_tokens=False).ids
    assert asked.count("word") == 1 and asked.count("wörd") == 1 and not coder.words
    assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
