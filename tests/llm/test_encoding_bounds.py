"""Folding many pieces at once, and the bound of the chunk caches."""

import random

import public_tokenizers
import pyarrow as pa

from surgekit.llm import byte_bpe, encoding


def test_pieces_are_folded_together_as_one_by_one():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(11)
    pieces = [bytes(r.choice(b"etaoin shrdlu\xc3\xa9\xff0'") for _ in range(r.randint(1, 70))) for _ in range(500)]
    pieces += [b" the", b"a", b"x" * 47, b"x" * 48, b"x" * 49, b"ab" * 300]
    ids, first = byte_bpe.PairRanks(ranks).fold(pieces)
    for k, p in enumerate(pieces):
        assert ids[first[k]:first[k + 1]].tolist() == ([ranks[p]] if p in ranks else byte_bpe.merge(p, ranks))
    ids, first = byte_bpe.PairRanks(ranks).fold([])
    assert len(ids) == 0 and first.tolist() == [0]


def test_one_slice_does_not_outgrow_the_cache(monkeypatch):
    monkeypatch.setattr(encoding, "CACHED", 100)
    coder = encoding.ChunkCoder(lambda chunks: [(c.upper().encode(),) for c in chunks], 1)
    for k in range(3):
        body = pa.array([" ".join(f"w{k}x{i}" for i in range(1000)).encode(), b"w0x1 again"], pa.binary())
        rows = [bytes(v) for (column,) in coder.columns(body) for v in column]
        assert rows == [bytes(x).upper() for x in body.to_pylist()]
        assert len(coder.known) <= 151 and len(coder.older) <= 151


def test_words_beside_marks_and_line_feeds_are_not_new(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for special in (False, True):
        monkeypatch.setattr(encoding, "_CODERS", {})
        list(encoding.encode_bodies(path, pa.array([b"x one two three,\nfour", b"! ? ..."], pa.binary()), 2, special))
        asked = []
        coder = encoding.library_coder(path, special)
        monkeypatch.setattr(coder, "encode", lambda missing, f=coder.encode: asked.extend(missing.to_pylist()) or f(missing))
        text = b"x one, two, three,\nfour two\nx! one"
        got = list(encoding.encode_bodies(path, pa.array([text], pa.binary()), 2, special))
        assert set(asked) <= {b"!"}
        monkeypatch.setattr(encoding, "_CODERS", {})
        assert got == list(encoding.encode_bodies(path, pa.array([text], pa.binary()), 2, special))


def test_known_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "KNOWN", 100)
    monkeypatch.setattr(encoding, "SLICE_BYTES", 500)
    coder = encoding.ArrayCoder(lambda missing: pa.array([c.upper() for c in missing.to_pylist()], pa.large_binary()), encoding.chunks)
    r = random.Random(5)
    for _ in range(5):
        body = pa.array([" ".join(f"w{r.randint(0, 300)}" for _ in range(r.randint(0, 60))).encode() for _ in range(40)] + [b"long" * 50], pa.binary())
        assert [bytes(v) for v in coder.rows(body)] == [b.upper() for b in body.to_pylist()]
        assert len(coder.known) == len(coder.values) <= 100
        assert max(map(len, coder.known.to_pylist())) <= encoding.KNOWN_BYTES
