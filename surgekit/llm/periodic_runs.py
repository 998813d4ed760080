"""Periodic run detection by an online sparse diagonal DP.

A run is a longest stretch of words with smallest period q, at least ``LEAST`` words and two periods long. Seen as diagonals, words
that equal the ones a lag d before them: a run of period q is a diagonal of lag q with at least max(q, LEAST - q) >= ``GRAM`` matches
in a row. So a word's earlier occurrences are looked up together with the ``GRAM`` - 1 words before it, by which nearly all words
of ordinary text have none.

Words are then taken in order. Each earlier occurrence of a word continues the diagonal of its lag or, where the words before it differ,
begins one; a lag stays active while its words match, and when it ends the run is emitted. Two rules keep the active set sparse
without losing a run:

* A diagonal is begun only if its words match as far as a run of that lag needs (one comparison of prefix hashes a lag).
* Inside a run that is long enough already, of period q, only lags below q begin. A run with a longer period that isn't begun before
  or after that stretch would lie in it, and would have the period q (Fine and Wilf). Where the stretch ends, or a shorter period takes
  its place, all lags are looked at, and one that was passed over is followed back to its first match.

A lag that is a multiple of the period ends where the period's diagonal ends and spans the same words: of equal spans the least lag is
the run.

Each text is a task's own, found where it lies: no shuffle. Words are compared by 64-bit hashes.

Defined cases: null, empty and blank texts have no words and no runs; very long texts are worked on whole; where a document's words
are synthetic (``periodic_tail``) its doc_id decides, and a null doc_id leaves the words as they are; repeated rows are each returned;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashing
from .shared import byte_chunks, map_batches, texts

LEAST, GRAM = 12, 6
#: a run: (first word, words, smallest period)
Run = tuple[int, int, int]


def periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from ``a`` on repeat the ``p`` words that begin there: a tenth of the documents, by doc_id."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def tail_places(n: int, tail: tuple[int, int] | None) -> np.ndarray:
    """Which original word stands at each place."""
    at = np.arange(n)
    if tail is not None:
        a, p = tail
        at[a:] = a + (at[a:] - a) % p
    return at


def gram_names(codes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A name for each ``size`` words in a row."""
    n = max(0, len(codes) - size + 1)
    out = codes[:n].copy()
    for k in range(1, size):
        out = hashing.join(out, codes[k:n + k])
    return out


class Diagonals:
    """The words of one text. ``group`` has the ends of equal grams next to each other, in order; ``rank`` is an end's place in
    its group, ``first`` where the group starts."""

    def __init__(self, codes: np.ndarray, names: np.ndarray):
        self.codes = codes
        order = np.argsort(names, kind="stable")
        same = names[order][1:] == names[order][:-1]
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        sizes = np.diff(np.append(start, len(order)))
        self.group = order + GRAM - 1
        self.first = np.empty(len(order), np.int64)
        self.first[order] = np.repeat(start, sizes)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order)) - np.repeat(start, sizes)
        with np.errstate(over="ignore"):
            up, self.down = hashing._powers(len(codes) + 1, hashing.BASE)
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(codes.copy()) * up[:len(codes)])))

    def _span(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def earlier(self, i: int) -> np.ndarray:
        """The ends of the earlier occurrences of the gram that ends at ``i``, in order."""
        k = i - GRAM + 1
        return self.group[self.first[k]:self.first[k] + self.rank[k]]

    def nearest(self) -> tuple[list[int], list[bool]]:
        """By end of a gram: the end of its last earlier occurrence, and whether that is the only one."""
        at = self.group[self.first + np.maximum(self.rank - 1, 0)]
        pad = [0] * (GRAM - 1)
        return pad + at.tolist(), pad + (self.rank == 1).tolist()

    def matches_back(self, i: int, lag: int) -> int:
        """The first of the words up to ``i`` that all equal the ones ``lag`` before."""
        step, at = 64, i
        while at >= lag:
            low = max(lag, at - step + 1)
            differ = np.flatnonzero(self.codes[low:at + 1] != self.codes[low - lag:at + 1 - lag])
            if len(differ):
                return low + int(differ[-1]) + 1
            at, step = low - 1, 2 * step
        return at + 1

    def begun(self, i: int, most: int | None, passed: bool) -> list[tuple[int, int]]:
        """(lag, first match) of the diagonals that begin with the gram that ends at ``i``. ``most``: only lags below it;
        ``passed``: the words before may match too, as lags have been passed over."""
        at = self.earlier(i)
        if most is not None:
            at = at[np.searchsorted(at, i - most, side="right"):]
        before = i - GRAM
        if not passed and before >= 0:  # a diagonal that matches one word further back has begun already
            back = at - GRAM
            at = at[(back < 0) | (self.codes[np.maximum(back, 0)] != self.codes[before])]
        if not len(at):
            return []
        lag = i - at
        if passed:
            return [(d, b) for d in lag.tolist() if self._reaches(b := self.matches_back(i, d), d)]
        start, need = before + 1, np.maximum(lag, LEAST - lag)
        fits = start + need <= len(self.codes)
        lag, need = lag[fits], need[fits]
        here = np.full(len(lag), start)
        lag = lag[self._span(here, need) == self._span(here - lag, need)]
        return [(d, start) for d in lag.tolist()]

    def _reaches(self, start: int, lag: int) -> bool:
        need = max(lag, LEAST - lag)
        if start + need > len(self.codes):
            return False
        with np.errstate(over="ignore"):
            return bool(self._span(np.array([start]), need) == self._span(np.array([start - lag]), need))


def find_runs(codes: np.ndarray, names: np.ndarray | None = None) -> list[Run]:
    """The runs of a text by (start, period); ``codes`` has a name for each word, ``names`` one for each gram."""
    if len(codes) < LEAST:
        return []
    names = gram_names(codes) if names is None else names
    with np.errstate(over="ignore"):
        d = Diagonals(codes, names)
    seen = np.flatnonzero(d.rank > 0) + GRAM - 1  # ends of grams that have earlier occurrences
    if not len(seen):
        return []
    word = codes.tolist()
    nearest, single = d.nearest()
    active: dict[int, int] = {}
    spans: dict[tuple[int, int], int] = {}

    def ended(lag: int, start: int, last: int) -> None:
        if last - start + 1 >= max(lag, LEAST - lag):
            span = start - lag, last
            spans[span] = min(lag, spans.get(span, lag))
    last, inside = -2, None
    for i in seen.tolist():
        if i != last + 1:  # words between have no earlier occurrence: every diagonal ended with the last one
            for lag, start in active.items():
                ended(lag, start, last)
            active.clear()
            inside = None
        else:
            over = [lag for lag in active if word[i] != word[i - lag]]
            for lag in over:
                ended(lag, active.pop(lag), i - 1)
        period = min((lag for lag, start in active.items() if i - start + 1 + lag >= max(LEAST, 2 * lag)), default=None)
        left = inside is not None and period != inside
        near = nearest[i]
        back = near - GRAM
        # most words have nothing to begin: no shorter lag, or one earlier occurrence whose diagonal is active already
        if left or (i - near < period if period is not None else
                    not single[i] or back < 0 or word[back] != word[i - GRAM]):
            with np.errstate(over="ignore"):
                for lag, start in d.begun(i, None if left else period, left):
                    active.setdefault(lag, start)
        last, inside = i, period
    for lag, start in active.items():
        ended(lag, start, last)
    return sorted((s, e - s + 1, q) for (s, e), q in spans.items())


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: not those that a run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def chunk_runs(ids: list[int | None], data: np.ndarray, off: np.ndarray,
               tail: Callable[[int | None, int], tuple[int, int] | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[Run]]]:
    """(first bytes of words, ends, place of the original word at each place, runs) of each row's text."""
    starts, ends, rows = hashing.words(data, off)
    with np.errstate(over="ignore"):
        codes = hashing.spans(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    cut = np.searchsorted(rows, np.arange(len(off)))
    places = []
    for r, doc_id in enumerate(ids):
        a, b = int(cut[r]), int(cut[r + 1])
        places.append(tail_places(b - a, tail(doc_id, b - a)))
        codes[a:b] = codes[a:b][places[-1]]
    with np.errstate(over="ignore"):
        names = gram_names(codes)
    # rows with no gram twice have no runs; grams that cross a row's end don't count
    inside = np.flatnonzero(rows[:len(names)] == rows[GRAM - 1:]) if len(names) else np.zeros(0, np.int64)
    key = hashing.join(names[inside], rows[inside].astype(np.uint64)) if len(inside) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    twice = np.zeros(len(ids), bool)
    twice[rows[inside[order[1:][key[order][1:] == key[order][:-1]]]]] = True
    for r in range(len(ids)):
        a, b = int(cut[r]), int(cut[r + 1])
        runs = find_runs(codes[a:b], names[a:b - GRAM + 1]) if twice[r] and b - a >= LEAST else []
        yield starts[a:b], ends[a:b], places[r], runs


_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    ("collapsed", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
                     ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def _collapsed(body: bytes, starts: np.ndarray, ends: np.ndarray, places: np.ndarray, runs: list[Run], plain: bool) -> bytes:
    if plain and not runs:
        return b" ".join(body.split())  # bytes.split cuts at the six separators too
    keep = places[kept_words(len(places), runs)] if runs else places
    return b" ".join([body[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])


def _rows(batches: Iterator[pa.RecordBatch], tail) -> Iterator[list[tuple[int | None, list[Run], bytes]]]:
    """(doc_id, runs, collapsed text) by chunk."""
    for batch in batches:
        for a, b, data, off in byte_chunks(batch):
            ids = batch.column("doc_id").slice(a, b - a).to_pylist()
            whole = data.tobytes()
            out = []
            for r, (starts, ends, places, runs) in enumerate(chunk_runs(ids, data, off, tail)):
                base = int(off[r])
                body = whole[base:int(off[r + 1])]
                plain = len(places) == 0 or int(places[-1]) == len(places) - 1
                out.append((ids[r], runs, _collapsed(body, starts - base, ends - base, places, runs, plain)))
            yield out


def _no_tail(doc_id: int | None, n: int) -> None:
    return None


def collapse(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] = _no_tail) -> DataFrame:
    """(doc_id, runs, collapsed): all runs by (start, period), and the text without repeated periods, words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, tail):
            yield pa.RecordBatch.from_pylist([{"doc_id": d, "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs],
                                               "collapsed": text.decode()} for d, runs, text in rows], schema=_ARROW)
    return map_batches(texts(docs), run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digest(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] = periodic_tail) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), a row for each row of ``docs``; the
    longest run's values (of equal ones the first, then the least period), null without runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches, tail):
            out = []
            for doc_id, runs, text in rows:
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
                out.append((doc_id, len(runs), *values, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
    return map_batches(texts(docs), run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                       "runs_sha256 string, collapsed_sha256 string")
