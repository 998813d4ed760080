"""Encoding, directly addressable codes and the separator scan against the libraries and plain loops."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from surgekit.llm import token_codes, token_counts
from surgekit.llm.encoding import encode_bodies

JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, h string"
TEXTS = [None, "", " ", "a", "a  b", "  lead", "trail \n", "it's we'll  x", "tab\t x", "x \x1c y", "naïve çàé ñ 漢字 🙂", "a\n b\n\nc",
         "<|endoftext|> x", "1234 56", "word " * 300, " em  space　", "don't!!! ### $$$ a"]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def default():
    """As the library does by itself: a special token's string gives its id."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def random_texts(n=200):
    r = random.Random(3)
    alphabet = "ab cdé\n\t  '.,!?19 ñ漢"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(n)]


MARK = "<|endoftext|>"


@pytest.mark.parametrize("special", [False, True])
def test_chunks_give_the_ids_of_the_whole_text(whole, default, special):
    r = random.Random(4)
    texts = [t or "" for t in TEXTS] + random_texts() + [f"a{x}{MARK}{y}b{MARK}" for x in ("", " ", "\n", ",") for y in ("", " ", "  ", "\t")]
    texts += ["".join(r.choice(["a", " ", "\u00a0", "\u2003", "\u3000", "\u0085", "\u1680", "\u2028", "é", "漢", "\x1c", "\u205f", "\u200b"])
                      for _ in range(30)) for _ in range(300)]
    want = default if special else whole
    bodies = pa.array([t.encode() for t in texts], pa.binary())
    for text, got in zip(texts, encode_bodies(JSON, bodies, 2, special), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*want(text), 2], repr(text)
    assert 50256 in want(f"x{MARK}") or not special


def test_codes_round_trip_and_random_access():
    r = np.random.default_rng(0)
    for ids in (np.array([0]), np.array([255, 256, 65535, 65536, 2**32 - 1]), r.integers(0, 50257, 5000), r.integers(0, 300, 2000)):
        codes = token_codes.Codes.from_blobs(*token_codes.Codes.of(ids).blobs())
        assert (codes.decode() == ids).all()
        assert all(codes.token(i) == ids[i] for i in range(0, len(ids), 7))


def test_op1_files(spark, default):
    rows = [(i * 3 % 101, t, "x") for i, t in enumerate(TEXTS + random_texts(80))] + [(None, "null id", None), (3, "again", None)]
    segments = token_codes.write_codes(spark.createDataFrame(rows, SCHEMA).repartition(4), JSON, 2)
    got = sorted(token_codes.read_back(segments).collect(), key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    want = sorted((i is not None, i or 0, zlib.crc32(np.array([*default(t or ""), 2], "<u4").tobytes())) for i, t, _ in rows)
    assert want == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in got)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    places = spark.createDataFrame([(p,) for p in range(0, start, 37)], "place long")
    flat = {r["doc_id"]: r for r in got}
    assert flat[None]["start"] == 0
    tokens = {r["place"]: r["token"] for r in token_codes.tokens_at(segments, places).collect()}
    assert len(tokens) == len(range(0, start, 37))
    assert tokens[0] == default("null id")[0]


def test_op1_empty(spark):
    assert token_codes.read_back(token_codes.write_codes(spark.createDataFrame([], SCHEMA), JSON, 2)).collect() == []


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks(spark, whole, block):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(2, "twice", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    flat = token_counts.write_flat(docs, JSON, 50256, block)
    found = token_counts.scan(flat, 50256).join(token_counts.names(flat), ["file", "place"]).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found) == sorted((i, len(whole(t or ""))) for i, t, _ in rows)
    assert all(r["ended"] for r in found)


def test_scan_of_an_unended_stream(spark):
    ids = [[5, 9, 7], [9, 9, 1], [2, 3], [9], []]
    rows = [(0, b, np.array(x, "<u2").tobytes(), []) for b, x in enumerate(ids)] + [(1, 0, np.array([4, 4], "<u2").tobytes(), [])]
    got = token_counts.scan(spark.createDataFrame(rows, "file int, block int, data binary, named array<long>"), 9)
    assert sorted((r["file"], r["place"], r["start"], r["n_tokens"], r["ended"]) for r in got.collect()) == [
        (0, 0, 0, 1, True), (0, 1, 2, 1, True), (0, 2, 4, 0, True), (0, 3, 5, 3, True), (1, 0, 0, 2, False)]


def test_op4_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, file int, place int")
    assert [(r["doc_id"], r["n_tokens"]) for r in token_counts.document_counts(df, JSON, 50256).collect()] == [(1, 2)]
    assert token_counts.document_counts(df.where(F.lit(False)), JSON, 50256).collect() == []


def test_ids_beyond_two_bytes(spark, whole):
    docs = spark.createDataFrame([(1, "a b c", None), (2, "d", None)], SCHEMA)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_counts(docs, JSON, 70_000).collect()}
    assert got == {1: len(whole("a b c")), 2: len(whole("d"))}
    with pytest.raises(Exception, match="does not fit"):
        token_counts.write_flat(docs, JSON, 70_000)
