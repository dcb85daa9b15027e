"""Counts by distinct words against the library on whole texts."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quire.llm import token_counts  # noqa: E402


def test_words_count_like_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.by_word(path) and not token_counts.by_word(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = token_counts.load(path)
    rng = random.Random(3)
    pool = ["a", "b", " ", "  ", "\n", "\t", "漢字", "é", "😀", "'s", "<|endoftext|>", " <|endoftext|>", "\xa0", "　", "12", "...", "\x1c", "\x85", "\x00", "क्षि", "the", " the", "\r\n", " x", "'ll", " '"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(8000)] + ["", " ", "  ", "a ", " a", "word " * 700, None]
    for t in texts:
        assert "".join(token_counts.cut_words(t or "")) == (t or "")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path).collect()}
    want = [len(c) for c in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[i] for i in range(len(texts))] == want
