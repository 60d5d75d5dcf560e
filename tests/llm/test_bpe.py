"""Encoding against the public library, and exact round trips."""

import random

import pytest

from ledgerloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.parse_vocabulary(open(bpe.VOCABULARY, "rb").read())
    import public_tokenizers

    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(both):
    encoder, library = both
    rng = random.Random(3)
    alphabet = "aeihnorst ABC's., \n\t0129éüß東京 🙂\x1c\x85  _-<|endoftext|>'ll"
    for k in range(3000):
        text = "".join(rng.choice(alphabet if k % 2 else "aeihnorst") for _ in range(rng.randint(1, 60)))
        got = [i for p in bpe.pieces(text) for i in encoder.encode_piece(p)]
        assert got == library.encode_ordinary(text), repr(text)
        assert encoder.decode(got) == text


def test_long_pieces_take_linear_time(both):
    encoder, _ = both
    text = "ab" * 50_000 + "zq" * 20_000
    assert encoder.decode(encoder.encode_piece(text)) == text


def test_rows(spark, both):
    _, library = both
    texts = [None, "", " ", "plain text", "<|endoftext|>", "x" * 100_000, "plain text", "naïve​ café"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    sizes = {r["doc_id"]: r["tokens"] for r in bpe.count_tokens(df, "doc_id", "text").collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, "doc_id", "text").collect() == []
    assert bpe.encode(df, "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
