"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are normalised (A-Z lower-cased, runs of white space as one space). The edit budget comes first: an item of m bytes may
differ from a passage by e = floor(``RATE`` * m) edits, a tenth of it. ``Q`` = 8 follows from it: a passage within e edits shares at least
t = m - q + 1 - q * e q-grams with the item, about m / 5 with these values (e is less for items of under 40 bytes, so that t stays
1 or more), all on diagonals (place in text minus place in item) that lie within e of each other. For each text and item, shared q-grams
are counted in diagonal bands of 2 (e + 1) that overlap by half, so one band holds all of them; bands with t or more are kept and
verified by banded alignment: the item against any part of the text, least edits, over the band's diagonals and e more on
both sides (about m * 4 e cells).

A gram that is frequent in a text and in an item is counted without listing its pairs: by item place, all the text's places at once,
into one counter a band (``counted_bands``), so memory is that of the text and not of the product.

The items' index is broadcast, in blocks of at most about ``BLOCK_BYTES`` of item text (an index of some 25 bytes a byte); with more
items the texts are read once a block. Each text is searched whole, where it lies: no shuffle.

Defined cases: null text counts as empty; null or blank items match nothing; items shorter than q must occur exactly;
repeated items are reported each, repeated documents row by row; long and repetitive texts and items take time, not memory; an empty
table gives an empty result; other columns are kept by ``drop_contaminated`` and not read by ``leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .shared import byte_chunks, map_batches, texts

Q, RATE = 8, 0.10
BLOCK_BYTES = 4 << 20
FILTER_BITS = 20
#: Shared q-grams of a slice of texts that are listed; a row with more is counted item by item.
LISTED = 1 << 21


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, their offsets, place of each in ``data``); rows stay apart."""
    low = hashing.LOWER[data]
    blank = hashing.SEPARATOR[low]
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = True
    place = np.flatnonzero(keep)
    return np.where(blank, np.uint8(32), low)[place], np.searchsorted(place, offsets), place


def normal(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip(b" ")


@dataclass
class Index:
    """The items' q-grams: sorted distinct hashes with their postings, and a filter over hash prefixes."""
    ids: list[int]
    bodies: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    maybe: np.ndarray
    short: list[int]

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], q: int = Q, rate: float = RATE) -> Index:
        ids, bodies = [i for i, _ in items], [b for _, b in items]
        m = np.array([len(b) for b in bodies], np.int64)
        edits = np.maximum(0, np.minimum((rate * m + 1e-9).astype(np.int64), (m - q) // q))
        long = [i for i, b in enumerate(bodies) if len(b) >= q]
        grams = [hashing.windows(np.frombuffer(bodies[i], np.uint8), q) for i in long]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.array(long, np.int32), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams]) if grams else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        h, item, pos = h[order], item[order], pos[order]
        distinct, first = np.unique(h, return_index=True)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[(distinct >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(ids, bodies, edits, np.maximum(1, m - q + 1 - q * edits), distinct, np.append(first, len(h)), item, pos, maybe,
                   [i for i, b in enumerate(bodies) if len(b) < q])


def hits(index: Index, data: np.ndarray, offsets: np.ndarray, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the row's text, slot in the index) of every q-gram of a text that an item has."""
    h = hashing.windows(data, q)
    at = np.flatnonzero(index.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    slot = np.searchsorted(index.grams, h[at])
    slot[slot == len(index.grams)] = 0
    hit = index.grams[slot] == h[at] if len(index.grams) else np.zeros(len(at), bool)
    at, slot = at[hit], slot[hit]
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + q <= offsets[row + 1]
    at, slot, row = at[inside], slot[inside], row[inside]
    return row, at - offsets[row], slot


def listed_grams(index: Index, row: np.ndarray, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, diagonal) of every pair of a hit and a place of its gram in an item."""
    n = index.first[slot + 1] - index.first[slot]
    posting = np.repeat(index.first[slot], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return np.repeat(row, n), index.item[posting].astype(np.int64), np.repeat(at, n) - index.pos[posting]


def counted_bands(index: Index, at: np.ndarray, slot: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, lowest diagonal, highest diagonal) of one text's kept bands, from its hits in order of place: pairs of places are counted
    and never listed."""
    order = np.argsort(slot, kind="stable")
    at, slot = at[order], slot[order]
    start = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    grams, ends = slot[start], np.append(start[1:], len(slot))
    pairs = [(int(index.item[k]), int(index.pos[k]), g) for g, x in enumerate(grams.tolist()) for k in range(index.first[x], index.first[x + 1])]
    pairs.sort()
    last, counts, low = None, None, 0
    for item, pos, g in [*pairs, (None, 0, 0)]:
        if item != last:
            if last is not None:
                full = counts[:-1] + counts[1:]
                step = int(index.edits[last]) + 1
                for b in np.flatnonzero(full >= index.least[last]).tolist():
                    yield last, (low + b) * step, (low + b + 2) * step - 1
            if item is None:
                return
            last, step = item, int(index.edits[item]) + 1
            low = -len(index.bodies[item]) // step - 1
            counts = np.zeros(int(at.max()) // step - low + 2, np.int64)
        band = (at[start[g]:ends[g]] - pos) // step - low
        counts += np.bincount(band, minlength=len(counts))


def bands(index: Index, data: np.ndarray, offsets: np.ndarray, q: int = Q) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, lowest diagonal, highest diagonal) of all kept bands."""
    row, at, slot = hits(index, data, offsets, q)
    n = index.first[slot + 1] - index.first[slot]
    of_row = np.bincount(row, n, len(offsets) - 1)
    many = of_row > LISTED
    plain = np.flatnonzero(~many[row])
    while len(plain):  # whole rows, as many as may be listed together
        total = np.cumsum(n[plain])
        last = row[plain[max(0, int(np.searchsorted(total, LISTED, side="right")) - 1)]]
        end = int(np.searchsorted(row[plain], last, side="right"))
        if total[end - 1] > LISTED and row[plain[0]] != last:
            end = int(np.searchsorted(row[plain], last, side="left"))
        part, plain = plain[:end], plain[end:]
        yield from zip(*(x.tolist() for x in kept_bands(index, *listed_grams(index, row[part], at[part], slot[part]))), strict=True)
    for r in np.flatnonzero(many).tolist():
        a, b = np.searchsorted(row, [r, r + 1])
        for item, low, high in counted_bands(index, at[a:b], slot[a:b]):
            yield r, item, low, high


def kept_bands(index: Index, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, lowest diagonal, highest diagonal) of the bands that hold enough shared q-grams."""
    if not len(row):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    step = index.edits[item] + 1
    band = diagonal // step
    low = int(band.min()) - 1
    span = int(band.max()) - low + 1
    n_items = len(index.bodies)
    key = (row * n_items + item) * span + (band - low)
    key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    pair, band = key // span, key % span + low
    row, item = pair // n_items, pair % n_items
    keep = count >= index.least[item]
    row, item, band = row[keep], item[keep], band[keep]
    step = index.edits[item] + 1
    return row, item, band * step, (band + 2) * step - 1


def align(item: bytes, text: bytes, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``text`` closest to ``item`` on the diagonals from ``low`` to ``high``, if within ``most``
    edits; earliest end of equals, then the latest start."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    if most == 0:
        return None
    first, ends = _last_row(item, text, low, high, most)
    k = int(ends.argmin())
    if ends[k] > most:
        return None
    end = first + k
    shift = end - len(item)  # reversed, a diagonal d becomes end - m - d
    back, starts = _last_row(item[::-1], text[:end][::-1], shift - high, shift - low, most)
    k = int(np.flatnonzero(starts <= ends[k])[0])
    return int(starts[k]), end - (back + k), end


_FAR = 1 << 30
#: Rows of the recurrence between two looks at whether the budget is spent.
LOOK = 12


def _last_row(item: bytes, text: bytes, low: int, high: int, most: int = _FAR) -> tuple[int, np.ndarray]:
    """(first place, least edits of the item against a part of the text that ends at it and at the following places), over paths on the
    diagonals from ``low`` to ``high``. Row i of the recurrence holds the places i + low to i + high only. A row's least value
    never falls from one row to the next, so once it is above ``most`` no end can be within it: then one far value is returned."""
    t = np.frombuffer(text, np.uint8)
    width, m = high - low + 1, len(item)
    padded = np.zeros(m + width + 2, np.int16) - 1  # text places low.. of the band's parallelogram, -1 outside of the text
    a, b = max(0, low), min(len(t), low + len(padded))
    if b > a:
        padded[a - low:b - low] = t[a:b]
    ramp = np.arange(width, dtype=np.int64)
    place = ramp + low
    row = np.where((place >= 0) & (place <= len(t)), 0, _FAR)
    codes = np.frombuffer(item, np.uint8)
    for i in range(1, m + 1):
        place = place + 1
        new = row + (padded[i - 1:i - 1 + width] != codes[i - 1])   # the same diagonal: a character against one of the text
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])             # the next one: an item's character is left out
        new[(place < 0) | (place > len(t))] = _FAR
        row = np.minimum(np.minimum.accumulate(new - ramp) + ramp, _FAR)  # the one before: a text's character is left out
        if place[-1] > len(t):
            row[place > len(t)] = _FAR
        if i % LOOK == 0 and row.min() > most:
            return 0, np.array([_FAR])
    keep = np.flatnonzero((place >= 0) & (place <= len(t)))
    if not len(keep):
        return 0, np.array([_FAR])
    return int(place[keep[0]]), row[keep]


def search(index: Index, data: np.ndarray, offsets: np.ndarray, q: int = Q) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(row, item's place): (edits, start, end)}: the closest passage of each item in each row's text, in its bytes."""
    text, off, place = normalise(data, offsets)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def offer(row: int, item: int, low: int, high: int) -> None:
        best = found.get((row, item))
        body, most = index.bodies[item], int(index.edits[item])
        start, size = max(0, low - most), int(off[row + 1] - off[row])
        if best is not None and best[0] == 0 and best[1] <= int(place[min(off[row] + start, len(place) - 1)] - offsets[row]):
            return  # an exact and earlier one can't be bettered
        region = text[off[row] + start:off[row] + min(size, high + len(body) + most)].tobytes()
        got = align(body, region, most, low - most - start, high + most - start)
        if got is not None:
            a, b = int(off[row]) + start + got[1], int(off[row]) + start + got[2]
            first = int(place[a] - offsets[row])
            last = int(place[b - 1] - offsets[row]) + 1 if b > a else first
            if best is None or (got[0], first) < best[:2]:
                found[row, item] = got[0], first, last
    for r, i, low, high in bands(index, text, off, q):
        offer(r, i, low, high)
    for i in index.short:
        for r in range(len(off) - 1):
            offer(r, i, 0, int(off[r + 1] - off[r]))
    return found


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """The items, normalised, in blocks of bounded size; blank ones are left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        block = [(r["item_id"], body) for r in rows if (body := normal(r["text"]))]
        if block:
            yield block


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, start, end, similarity): a row for each document and item that it holds; start and end are byte
    places in the text, similarity is 1 - edits / item bytes."""
    schema = "doc_id long, item_id long, edits int, start long, end long, similarity double"
    rows, out = texts(docs), None
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index.of(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for a, b, data, off in byte_chunks(batch):
                    ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                    found = [(ids[r], index.ids[i], e, s, t, 1.0 - e / len(index.bodies[i]))
                             for (r, i), (e, s, t) in sorted(search(index, data, off, q).items())]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                            zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                            ["doc_id", "item_id", "edits", "start", "end", "similarity"])
        part = map_batches(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all their columns unchanged."""
    names, schema = docs.columns, docs.schema
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index.of(block, q, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, off in byte_chunks(batch, column="__body"):
                    clean = np.ones(b - a, bool)
                    clean[[r for r, _ in search(shared.value, data, off, q)]] = False
                    yield batch.slice(a, b - a).select(names).filter(pa.array(clean))
        body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
        docs = map_batches(docs.withColumn("__body", body), run, schema)
    return docs
