"""Ranked merges against the tiktoken library."""

import hashlib

import public_tokenizers
import pytest

from surgekit.llm import byte_bpe
from test_tokens import TEXTS, random_texts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string"
ALL = [*TEXTS, *random_texts(120), "x" * 5000, "ab" * 700 + " " + "é" * 400, "\U0001fadf new \U0001ccd6 x", "tion " * 50]


@pytest.fixture(scope="module")
def library():
    import tiktoken
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("frequent", [0, 8, 10_000])
def test_ids_and_round_trip(spark, library, frequent):
    rows = [(i, t, "x") for i, t in enumerate(ALL)] + [(None, "null id", None), (3, "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoder = byte_bpe.make_encoder(docs, RANKS, PATTERN, frequent)
    assert len(encoder.frequent) <= frequent and (frequent < 10_000 or len(encoder.frequent) > 20)
    want = sorted((i is not None, i or 0, len(ids := library(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in byte_bpe.digest(docs, encoder).collect())
    assert got == want
    if frequent == 8:
        encoded = byte_bpe.encode(docs, encoder)
        assert sorted((r["doc_id"] or -1, r["text"]) for r in byte_bpe.decode(encoded, RANKS).collect()) == sorted(
            (i or -1, t or "") for i, t, _ in rows)


def test_higher_order_functions_give_the_librarys_ids(spark, library):
    words = sorted({w for t in ALL if t for w in t.split(" ") if w and not w[0].isspace() and len(w) < 64})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = byte_bpe.encode_words(df, byte_bpe.read_ranks(RANKS), PATTERN).collect()
    assert len(rows) >= len(words) - 2
    for r in rows:
        assert r["ids"] == library(" " + r["word"]) and bytes(r["decoded"]) == (" " + r["word"]).encode()


def test_long_pieces_merge_alike():
    ranks = byte_bpe.read_ranks(RANKS)
    for piece in (b"abcabc" * 20, "ñandú".encode() * 30, b" the" * 9, b"aaaaaaa"):
        assert byte_bpe.merge(piece, ranks) == byte_bpe.merge_long(piece, ranks)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.digest(docs, byte_bpe.make_encoder(docs, RANKS, PATTERN)).collect() == []
