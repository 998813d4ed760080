"""Lexical quality features of whole texts, computed on the bytes of a batch with numpy."""

from __future__ import annotations

import numpy as np

from . import hashing

NAMES = ["log_bytes", "upper", "digit", "space", "newline", "stop_mark", "comma", "bang", "pipe", "symbol", "quote", "high",
         "log_words", "word_len", "long_word", "symbol_word", "upper_word", "same_as_last", "distinct_words", "top_word",
         "words_per_line", "stop_per_word"]

_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t", "newline": b"\n\r", "stop_mark": b".;:?",
    "comma": b",", "bang": b"!", "pipe": b"|", "symbol": b"#$%&*+-/<=>@\\^_`~{}[]", "quote": b"\"'()", "high": bytes(range(128, 256)),
}
_MASKS = np.zeros((len(_CLASSES), 256), bool)
for _i, _v in enumerate(_CLASSES.values()):
    _MASKS[_i, list(_v)] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(NAMES)) of doubles; a text without words gets zeros wherever a mean over words is asked for."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per_byte = np.maximum(size, 1.0)
    counts = {name: _sums(_MASKS[i][data], offsets).astype(float) for i, name in enumerate(_CLASSES)}
    starts, ends, rows = hashing.words(data, offsets)
    per_row = np.searchsorted(rows, np.arange(n + 1))
    n_words = np.diff(per_row).astype(float)
    per_word = np.maximum(n_words, 1.0)
    length = ends - starts
    sym, up = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(_MASKS[list(_CLASSES).index("symbol")][data], out=sym[1:])
    np.cumsum(_MASKS[0][data], out=up[1:])
    h = hashing.spans(hashing.LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((h, rows))
    hs, rs = h[order], rows[order]
    first = np.ones(len(h), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    heads = np.flatnonzero(first)
    top = np.zeros(n)
    np.maximum.at(top, rs[heads], np.diff(np.append(heads, len(h))).astype(float))
    cols = [np.log1p(size), *(counts[k] / per_byte for k in _CLASSES),
            np.log1p(n_words), _sums(length, per_row) / per_word / 10, _sums(length > 15, per_row) / per_word,
            _sums((sym[ends] - sym[starts]) > 0, per_row) / per_word, _sums((up[ends] - up[starts]) > 1, per_row) / per_word,
            _sums(again, per_row) / per_word,
            np.bincount(rs[heads], minlength=n)[:n] / per_word, top / per_word,
            np.log1p(n_words / (counts["newline"] + 1)), counts["stop_mark"] / per_word]
    return np.stack(cols, axis=1)
