"""Whole-text encoding through the distinct chunks of a batch.

The public pattern never matches across a space that stands between two characters which are not white space: such a
space always opens the next piece. So a text may be cut before each of them, every distinct chunk encoded once, and the values
concatenated; the result equals that of the whole text. A space beside other white space, or beside a character that might be,
is no cut. Cuts are found on the bytes; the chunks of a batch are one Arrow array over the texts' own bytes, which is
dictionary-encoded, and the values of its dictionary are put back in order by ``take``: no Python loop over occurrences.

``fine_chunks`` cuts further where the pattern always cuts: words with and without a mark or a line feed beside them are then one
entry of the dictionary, and fewer of them are new.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import binary_views, worker_cache

#: Cached chunks of a generation and units of one Python worker, the longest that is kept, and the bytes of text worked on at once.
CACHED, CACHED_UNITS, CACHED_CHARS, SLICE_BYTES = 120_000, 60_000, 200, 8 << 20
#: The same of chunks that are kept in arrays: at most so many, of at most so many bytes.
KNOWN, KNOWN_BYTES = 400_000, 64


#: ASCII punctuation that may end a chunk.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ALNUM, _MARK = (np.array([chr(b) in found for b in range(256)]) for found in (string.ascii_letters + string.digits, _MARKS))


def _no_space_left(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place surely is no white space."""
    last, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
    three = (third >= 0xE1) & (third <= 0xE3) & ((second == 0x80) | (second == 0x81) | (second == 0x9A))
    return (last > 0x20) & ~two & ~three


def _no_space_right(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character after each place surely is no white space; two- and three-byte spaces begin with one of four bytes."""
    first, second = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
    three = (first >= 0xE1) & (first <= 0xE3) & ((second == 0x80) | (second == 0x81) | (second == 0x9A))
    return (first > 0x20) & ~two & ~three


def _lone(data: np.ndarray, byte: int, ends: np.ndarray) -> np.ndarray:
    """Places of a white byte inside a text, between characters that surely are no white space."""
    at = np.flatnonzero(data == byte)
    at = at[~ends[at]]
    return at[_no_space_left(data, at) & _no_space_right(data, at)]


def chunks(data: np.ndarray, off: np.ndarray, fine: bool = False) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """(the chunks of all rows' texts, each row's first chunk and one end more). A chunk has the space before it. ``fine``: also cut
    around a lone line feed and between an ASCII letter or digit and the ASCII mark after it."""
    first = np.zeros(len(data) + 1, bool)
    filled = np.diff(off) > 0
    first[off[:-1][filled]] = True
    ends = first.copy()
    ends[off[1:][filled] - 1] = True
    first[_lone(data, 0x20, ends)] = True
    if fine:
        feeds = _lone(data, 0x0A, ends)
        first[feeds] = first[feeds + 1] = True
        first[1:-1] |= _ALNUM[data[:-1]] & _MARK[data[1:]]
    first[len(data)] = False
    starts = np.flatnonzero(first)
    offsets = np.append(starts, len(data)).astype(np.int64)
    array_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return array_, np.searchsorted(starts, off)


def fine_chunks(data: np.ndarray, off: np.ndarray, marked: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Fine chunks; where a text holds a marked string, which must stay whole, the plain ones."""
    text = data.tobytes() if marked else b""
    return chunks(data, off, not any(m in text for m in marked))


def coded_slices(body: pa.Array, cut: Callable[[np.ndarray, np.ndarray], tuple[pa.LargeBinaryArray, np.ndarray]]) -> Iterator[
        tuple[pa.DictionaryArray, np.ndarray]]:
    """Slices of rows in order: for each its chunks, dictionary-encoded, and each row's first chunk and one end more."""
    data, off = binary_views(body)
    row, n = 0, len(off) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(off, off[row] + SLICE_BYTES, side="right")) - 1))
        parts, first = cut(data[off[row]:off[end]], off[row:end + 1] - off[row])
        yield parts.dictionary_encode(), first
        row = end


def _rows(values: pa.LargeBinaryArray, coded: pa.DictionaryArray, first: np.ndarray) -> list[memoryview]:
    """The rows' bytes: the values of their chunks, concatenated."""
    flat, places = binary_views(values.take(coded.indices))
    view, cuts = memoryview(np.ascontiguousarray(flat)), places[first].tolist()
    return [view[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class ChunkCoder:
    """``encode`` maps chunks (strings) to tuples of ``width`` byte strings; ``columns`` gives each text's, concatenated."""

    def __init__(self, encode: Callable[[list[str]], list[tuple[bytes, ...]]], width: int, frequent: dict[bytes, tuple[bytes, ...]] | None = None):
        self.encode, self.width = encode, width
        self.frequent = frequent or {}
        self.known: dict[bytes, tuple[bytes, ...]] = {}
        self.older: dict[bytes, tuple[bytes, ...]] = {}

    def _values(self, distinct: list[bytes]) -> list[tuple[bytes, ...]]:
        """The chunks' values. A full generation of the cache becomes the older one, from which chunks that are met again come back; one
        slice's new chunks fill a generation up to half beyond that, so that neither outgrows its bound."""
        if len(self.known) > CACHED:
            self.older, self.known = self.known, {}
        known, older, frequent = self.known, self.older, self.frequent
        out = list(map(known.get, distinct))
        missing = []
        for k in [k for k, v in enumerate(out) if v is None]:
            c = distinct[k]
            v = frequent.get(c)
            if v is None:
                v = older.get(c)
                if v is None:
                    missing.append(k)
                    continue
                known[c] = v
            out[k] = v
        if missing:
            room = CACHED + CACHED // 2 - len(known)
            for k, v in zip(missing, self.encode([distinct[k].decode() for k in missing]), strict=True):
                out[k] = v
                if room > 0 and len(distinct[k]) <= CACHED_CHARS:
                    known[distinct[k]] = v
                    room -= 1
        return out

    def columns(self, body: pa.Array) -> Iterator[list[list[memoryview]]]:
        """Slices of rows in order: for each, by column, the rows' bytes."""
        for coded, first in coded_slices(body, chunks):
            values = self._values(coded.dictionary.to_pylist())
            yield [_rows(pa.array([v[c] for v in values], pa.large_binary()), coded, first) for c in range(self.width)]


class ArrayCoder:
    """``encode`` maps an array of distinct chunks to the array of their values, ``cut`` makes the chunks; ``rows`` gives each text's
    values, concatenated. Known chunks and their values are two arrays too, so that a slice's are looked up at once; when they are
    full, those of the last slice take their place."""

    def __init__(self, encode: Callable[[pa.LargeBinaryArray], pa.LargeBinaryArray],
                 cut: Callable[[np.ndarray, np.ndarray], tuple[pa.LargeBinaryArray, np.ndarray]]):
        self.encode, self.cut = encode, cut
        self.known = self.values = pa.array([], pa.large_binary())

    def _values(self, distinct: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        at = pc.index_in(distinct, value_set=self.known)
        new = at.is_null()
        missing, place = distinct.filter(new), at.fill_null(0).to_numpy().astype(np.int64)
        place[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(missing))
        fresh = self.encode(missing)
        out = pa.concat_arrays([self.values, fresh]).take(pa.array(place))
        if len(self.known) + len(missing) > KNOWN:
            self.known = self.values = pa.array([], pa.large_binary())
            missing, fresh = distinct, out
        short = pc.less_equal(pc.binary_length(missing), KNOWN_BYTES)
        self.known = pa.concat_arrays([self.known, missing.filter(short)[:KNOWN]])
        self.values = pa.concat_arrays([self.values, fresh.filter(short)[:KNOWN]])
        return out

    def rows(self, body: pa.Array) -> Iterator[memoryview]:
        """The rows' bytes in order."""
        for coded, first in coded_slices(body, self.cut):
            yield from _rows(self._values(coded.dictionary), coded, first)


def units(chunk: str) -> list[str]:
    """Cuts a chunk where the pattern always cuts: around a line feed between characters that aren't white space, and
    between a letter or number and the punctuation that ends the chunk."""
    if chunk.isalpha() or chunk[1:].isalpha():
        return [chunk]
    out = []
    lines = chunk.split("\n")
    if len(lines) > 1 and not all(x and not x[-1].isspace() and (k == 0 or not x[0].isspace()) for k, x in enumerate(lines)):
        lines = [chunk]
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        core = line.rstrip(_MARKS)
        if core and len(core) < len(line) and core[-1].isalnum():
            out += (core, line[len(core):])
        else:
            out.append(line)
    return out


def _byte_chars() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones for themselves, the others in order
    from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()
#: Below this character all Unicode versions agree what a letter is.
_LATIN_END = "\u0370"

_LETTERS = re.compile(" ?[" + "".join([c for c in map(chr, range(ord(_LATIN_END))) if c.isalpha()]) + "]+").fullmatch


def is_one_piece(unit: str) -> bool:
    """Whether a unit is letters, with or without a space before them: one piece of the pattern."""
    return _LETTERS(unit) is not None


#: Plain chunks that are encoded as one text.
JOINED = 500
_PLAIN = r"^ [^\x00-\x20]+$"

_CODERS: dict[tuple[str, bool], ArrayCoder] = worker_cache({})


def library_coder(path: str, special: bool = False) -> ArrayCoder:
    """Chunk -> ids as (little-endian) unsigned 32-bit bytes, by the tokenizers library. ``special``: the strings of special tokens in
    a text give their ids, as the library does by default; else they are ordinary text."""
    if (path, special) not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        marked = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if special else []

        merges = tokenizer.model.tokenize
        done: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        opens = np.zeros(max(vocabulary.values()) + 1, bool)
        opens[[i for t, i in vocabulary.items() if t.startswith(_BYTE_CHARS[0x20])]] = True

        def encode(missing: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
            """Plain chunks have one space, in front, which only one id of theirs can begin with: many of them are encoded as one text and
            told apart by those ids. The others are encoded each, as are plain ones beside the string of a special token."""
            words = missing.cast(pa.large_string())
            plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
            places, left = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
            data, off = binary_views(missing.filter(pa.array(plain)))
            groups = [places[a:a + JOINED] for a in range(0, len(places), JOINED)]
            joined = [data[off[a]:off[min(a + JOINED, len(places))]].tobytes().decode() for a in range(0, len(places), JOINED)]
            order, flat, lengths = [], [], []
            for group, text, e in zip(groups, joined, tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                starts = np.flatnonzero(opens[ids])
                if len(starts) == len(group) and not any(m in text for m in marked):
                    order.append(group)
                    flat.append(ids)
                    lengths.append(np.diff(starts, append=len(ids)))
                else:
                    left += group.tolist()
            each = encode_each(words.take(pa.array(left, pa.int64())).to_pylist())
            order.append(np.array(left, np.int64))
            flat.append(np.frombuffer(b"".join(each), "<u4"))
            lengths.append(np.array([len(v) // 4 for v in each], np.int64))
            ends = np.append(0, 4 * np.cumsum(np.concatenate(lengths))).astype(np.int64)
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(missing), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(flat))])
            return values.take(pa.array(np.argsort(np.concatenate(order))))

        def encode_each(chunks: list[str]) -> list[bytes]:
            if len(done) > CACHED_UNITS:
                done.clear()
            out, rest = [], []
            for chunk in chunks:
                values = []
                for u in [chunk] if any(m in chunk for m in marked) else units(chunk):
                    v = done.get(u)
                    if v is None:
                        if is_one_piece(u):  # straight to the merges
                            piece = u.encode().decode("latin-1").translate(_BYTE_CHARS)
                            v = array("I", [t.id for t in merges(piece)]).tobytes()
                            if len(u) <= CACHED_CHARS:
                                done[u] = v
                        else:
                            rest.append((u, values, len(values)))
                    values.append(v)
                out.append(values)
            ids = tokenizer.encode_batch_fast([u for u, _, _ in rest], add_special_tokens=False)
            for (u, values, k), e in zip(rest, ids, strict=True):
                values[k] = array("I", e.ids).tobytes()
                if len(u) <= CACHED_CHARS:
                    done[u] = values[k]
            return [v[0] if len(v) == 1 else b"".join(v) for v in out]
        _CODERS[path, special] = ArrayCoder(encode, lambda data, off: fine_chunks(data, off, [m.encode() for m in marked]))
    return _CODERS[path, special]


def encode_bodies(path: str, body: pa.Array, end: int, special: bool = False) -> Iterator[bytes]:
    """Each text's ids with ``end`` after them, as little-endian unsigned 32-bit bytes; ``body`` has the texts' UTF-8 bytes."""
    close = array("I", [end]).tobytes()
    for ids in library_coder(path, special).rows(body):
        yield bytes(ids) + close
