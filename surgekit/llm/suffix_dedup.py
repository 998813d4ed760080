"""Removal of repeated 200-byte strings by bucket-pointer refinement over a sparse suffix order.

A string of ``LENGTH`` bytes repeats exactly if a suffix order holds two suffixes that agree on their first LENGTH bytes.
Sorting all suffixes of a corpus would move many times its size, so the order is built for anchors and refined only where
buckets stay undecided. Each pass is one range sort in which rows are compared with their neighbours:

1. *Initial buckets.* In every window of LENGTH bytes the q-gram with the least hash is its anchor (leftmost of equals),
   so equal windows have equal anchors at equal offsets, and about one position in seventy is an anchor. Anchors are
   sorted by (bucket of their q-gram, name of all the text that windows through the anchor can hold). The name joins the
   buckets of later offsets, doubling from q to LENGTH bytes and reusing each level's names in the next. Neighbours with
   equal (bucket, name) settle the whole stretch around the anchor as repeated; a bucket with a single row is done; of a
   bucket with differing names the first and the last of each run of equals go on.
2. *Refinement.* The windows of an anchor that goes on are cut into blocks of ``BLOCK`` starts. All windows of a block hold
   its core of LENGTH - BLOCK + 1 bytes; the bytes that some of them hold besides, BLOCK - 1 on either side, are its tail.
   Rows are sorted by (name of the core, tail) and settled as before: equal tails repeat, lone cores are done.
3. *Windows.* What is still undecided is sorted window by window, (name of the core, name of the window).

Sort keys end with the document and position, so a range partitioner splits even one bucket that holds a third of all rows.
Rows at the edges of a partition go on as undecided in passes 1 and 2, and meet in a small table (at most two rows a
partition) in pass 3. A decision rests on two 64-bit names, or on a 64-bit name and the bytes themselves. Texts move
as zstd frames, joined with their undecided anchors once and with the bytes to remove once.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing; a repeated row (same doc_id and
text) is another occurrence, so both lose what they share; rows with a null doc_id take part and are returned; an empty
table gives an empty result; other columns don't matter to ``dedup_digest`` and are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .shared import byte_chunks, map_batches, staged, texts

LENGTH, GRAM = 200, 25  # LENGTH is GRAM doubled three times
REACH = LENGTH - GRAM  # a window's anchor starts at most this far into it
#: Window starts of a block in the second pass, and blocks of an anchor. The core's name joins two overlapping names of
#: 4 * GRAM bytes, so LENGTH - BLOCK + 1 must lie between 4 and 8 times GRAM.
BLOCK = 16
BLOCKS = REACH // BLOCK + 1
POSITION_BITS, PIECE = np.uint64(24), 1 << 23
_DECOMPRESS = zstandard.ZstdDecompressor()


def _grams(data: np.ndarray, base: np.uint64) -> np.ndarray:
    return hashing.windows(data, GRAM, base)


def window_names(grams: np.ndarray) -> np.ndarray:
    """Name of each LENGTH-byte window from the buckets of its q-grams, by doubling."""
    names, size = grams, GRAM
    while size < LENGTH:
        names = hashing.join(names[:len(names) - size], names[size:]) if len(names) > size else names[:0]
        size *= 2
    return names


def window_starts(offsets: np.ndarray) -> np.ndarray:
    """Whether a window may start at each byte position of the chunk, that is, ends in the same text."""
    n = int(offsets[-1])
    ok = np.zeros(max(0, n - LENGTH + 1), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= LENGTH:
            ok[a:b - LENGTH + 1] = True
    return ok


def _owners(grams: np.ndarray, n: int) -> np.ndarray:
    """The anchor's position for each of the first ``n`` window starts: the least hash by its upper 40 bits, leftmost of
    equals, whatever the length of the text. The lower 24 bits hold the position within a piece of the text."""
    if n > PIECE:
        pieces = [at + _owners(grams[at:at + PIECE + REACH], min(PIECE, n - at)) for at in range(0, n, PIECE)]
        return np.concatenate(pieces)
    if n <= 0:
        return np.zeros(0, np.int64)
    low = ((grams >> POSITION_BITS) << POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    have, width = 1, REACH + 1
    while have * 2 <= width:  # sliding minimum by doubling
        low = np.minimum(low[:len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[width - have:width - have + n])
    return (low & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)


def anchors(grams: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all valid windows, ascending."""
    return np.unique(_owners(grams, len(valid))[valid])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, data, off in byte_chunks(batch):
            grams = _grams(data, hashing.BASE)
            at = anchors(grams, window_starts(off))
            if not len(at):
                continue
            row = np.searchsorted(off, at, side="right") - 1
            names = window_names(grams)
            first = np.maximum(off[row], at - REACH)
            last = np.minimum(off[row + 1] - LENGTH, at)
            name = hashing.join(hashing.join(names[first], names[last]),
                                ((at - first) * 4096 + (last - first)).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [_signed(grams[at]), _signed(name), batch.column("doc_id").slice(a).take(pa.array(row)),
                 batch.column("h").slice(a).take(pa.array(row)), pa.array((at - off[row]).astype(np.int32))],
                ["bucket", "name", "doc_id", "h", "pos"])


def _with_neighbours(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """For each batch of a sorted partition: (batch, key columns, keys of the row before, keys of the row after, is it the
    partition's first batch, its last). Holds one batch and one row."""
    before, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held is not None:
            yield (*held, before, [c[0] for c in cols])
            before = [c[-1] for c in held[1]]
        held = (batch, cols)
    if held is not None:
        yield (*held, before, None)


def _compare(one: np.ndarray, two: np.ndarray, before: list | None, after: list | None) -> tuple[np.ndarray, np.ndarray]:
    """(twin, goes_on) of each row: a neighbour equal in both keys; a neighbour equal in the first key only, or none known."""
    same_one, same_two = one[1:] == one[:-1], two[1:] == two[:-1]
    def padded(inner, first, last):  # with the row before and with the row after
        return np.concatenate(([first], inner)), np.concatenate((inner, [last]))
    p1, n1 = padded(same_one, before is not None and one[0] == before[0], after is not None and one[-1] == after[0])
    p2, n2 = padded(same_two, before is not None and two[0] == before[1], after is not None and two[-1] == after[1])
    twin = (p1 & p2) | (n1 & n2)
    goes_on = (p1 & ~p2) | (n1 & ~n2)
    goes_on[0] |= before is None
    goes_on[-1] |= after is None
    return twin.astype(bool), goes_on.astype(bool)


def _settle_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors whose surroundings repeat (twin) and undecided ones; a row may be both."""
    for batch, (bucket, name), before, after in _with_neighbours(batches, ["bucket", "name"]):
        for is_twin, mask in zip((True, False), _compare(bucket, name, before, after), strict=True):
            if mask.any():
                b = batch.filter(pa.array(mask))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("pos"),
                                                  pa.array(np.full(b.num_rows, is_twin))], ["doc_id", "h", "pos", "twin"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of window starts that an undecided anchor owns: name of the core, tail, place of the block's first
    start (before the text's first byte if the block is cut off there). A tail ends with the sizes of its two sides."""
    side, core = BLOCK - 1, LENGTH - BLOCK + 1
    for batch in batches:
        bodies = [_DECOMPRESS.decompress(z) for z in batch.column("z").to_pylist()]
        open_at = batch.column("open")
        for i, body in enumerate(bodies):
            data = np.frombuffer(body, np.uint8)
            size = len(data)
            grams = _grams(data, hashing.BASE)
            at = np.unique(open_at[i].values.to_numpy(zero_copy_only=False).astype(np.int64))
            owner = _owners(grams, size - LENGTH + 1)
            mine = np.isin(owner, at)
            start = np.flatnonzero(mine)
            anchor = owner[mine]
            code = np.unique(anchor * BLOCKS + (anchor - start) // BLOCK)
            if not len(code):
                continue
            anchor, k = code // BLOCKS, code % BLOCKS
            first = anchor - k * BLOCK - side  # the block's first window start; its core starts ``side`` later
            fifty = hashing.join(grams[:-GRAM], grams[GRAM:])
            hundred = hashing.join(fifty[:-2 * GRAM], fifty[2 * GRAM:])
            name = hashing.join(hundred[first + side], hundred[first + side + core - 4 * GRAM])
            padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side, np.uint8)])
            ahead = np.arange(side)
            left_size = np.minimum(side, first + side)
            right_size = np.minimum(side, size - (first + LENGTH))
            left = padded[(first + side)[:, None] + ahead]
            right = padded[(first + LENGTH + side)[:, None] + ahead]
            tail = np.concatenate([left, right, left_size[:, None].astype(np.uint8), right_size[:, None].astype(np.uint8)], axis=1)
            rows = pa.array(np.full(len(code), i))
            yield pa.RecordBatch.from_arrays(
                [_signed(name), pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(tail.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(tail).tobytes())]).cast(pa.binary()),
                 batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array(first.astype(np.int32))],
                ["core", "tail", "doc_id", "h", "pos"])


def _tails(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * BLOCK)


def _settle_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated blocks as byte ranges (tail null); undecided blocks with their tails (lo is the block's first start)."""
    for batch, (core, tail), before, after in _with_neighbours(batches, ["core", "tail"]):
        twin, goes_on = _compare(core, tail, before, after)
        if twin.any():
            b = batch.filter(pa.array(twin))
            t = _tails(b.column("tail")).astype(np.int64)
            first = b.column("pos").to_numpy().astype(np.int64)
            lo, hi = first + BLOCK - 1 - t[:, -2], first + t[:, -1] + LENGTH
            yield _ranges(b, lo, hi, pa.nulls(len(lo), pa.int64()), pa.nulls(len(lo), pa.binary()))
        if goes_on.any():
            b = batch.filter(pa.array(goes_on))
            first = b.column("pos").to_numpy()
            yield _ranges(b, first, first, b.column("core"), b.column("tail"))


def _ranges(b: pa.RecordBatch, lo: np.ndarray, hi: np.ndarray, core: pa.Array, tail: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                                       core, tail], ["doc_id", "h", "lo", "hi", "core", "tail"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the undecided blocks, named by its core and by the part of the tail that it holds."""
    side = BLOCK - 1
    for batch in batches:
        if not batch.num_rows:
            continue
        tails = _tails(batch.column("tail"))
        up, down = hashing._powers(2 * side + 1, hashing.BASE)
        sums = np.zeros((len(tails), 2 * side + 1), np.uint64)
        np.cumsum(hashing._TABLES[int(hashing.BASE)][tails[:, :2 * side]] * up[:2 * side], axis=1, out=sums[:, 1:])
        j = np.arange(BLOCK)
        part = hashing.mix((sums[:, j + side] - sums[:, j]) * down[j])
        core = batch.column("core").to_numpy().view(np.uint64)
        name = hashing.join(hashing.join(part, np.broadcast_to(core[:, None], part.shape)), np.broadcast_to(j.astype(np.uint64), part.shape))
        ok = (j >= side - tails[:, -2:-1]) & (j <= tails[:, -1:])
        row, col = np.nonzero(ok)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("core").take(rows), _signed(name[row, col]), batch.column("doc_id").take(rows), batch.column("h").take(rows),
             pa.array((batch.column("lo").to_numpy()[row] + col).astype(np.int32))], ["core", "name", "doc_id", "h", "pos"])


def _settle_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows; the first and the last row of a partition come with their names (edge true) whatever they are."""
    for batch, (core, name), before, after in _with_neighbours(batches, ["core", "name"]):
        twin, _ = _compare(core, name, before, after)
        edge = np.zeros(len(twin), bool)
        edge[0], edge[-1] = before is None, edge[-1] or after is None
        edge[0] |= len(twin) == 1 and after is None
        keep = twin | edge
        if keep.any():
            b = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("core", "name", "doc_id", "h", "pos")),
                                              pa.array(edge[keep]), pa.array(twin[keep])],
                                             ["core", "name", "doc_id", "h", "pos", "edge", "twin"])


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    """Range partitions (their number is the session's, small ones are put together) sorted by the same keys."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = pa.array([squeeze.compress(b) for b in batch.column("body").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), z], ["doc_id", "h", "z"])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, body): doc_id (for null a hash of the text) with a hash of the text names a row; rows equal in both
    hold the same text and get the same result."""
    t = texts(docs).withColumn("h", F.hash("body"))
    return t.select(F.coalesce("doc_id", F.xxhash64("body")).alias("doc_id"), "h", "body")


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(doc_id, h, gone): for each text with repeated windows its byte ranges, lo * 2**32 + hi; ends may lie outside of the
    text by less than LENGTH bytes. ``rows`` is what ``keyed`` gives."""
    made = map_batches(rows, _anchor_rows, "bucket long, name long, doc_id long, h int, pos int")
    settled = staged(map_batches(_sorted_by(made, "bucket", "name", "doc_id", "h", "pos"), _settle_anchors,
                                 "doc_id long, h int, pos int, twin boolean"), "anchors")
    undecided = settled.where("not twin").groupBy("doc_id", "h").agg(F.collect_set("pos").alias("open"))
    packed = map_batches(rows.where(F.length("body") >= LENGTH), _pack, "doc_id long, h int, z binary")
    blocks = map_batches(packed.join(undecided, ["doc_id", "h"]), _block_rows, "core long, tail binary, doc_id long, h int, pos int")
    blocks = staged(blocks, "blocks")
    ranges = staged(map_batches(_sorted_by(blocks, "core", "tail", "doc_id", "h", "pos"), _settle_blocks,
                                "doc_id long, h int, lo int, hi int, core long, tail binary"), "ranges")
    windows = map_batches(ranges.where("tail is not null"), _window_rows, "core long, name long, doc_id long, h int, pos int")
    found = staged(map_batches(_sorted_by(windows, "core", "name", "doc_id", "h", "pos"), _settle_windows,
                               "core long, name long, doc_id long, h int, pos int, edge boolean, twin boolean"), "windows")
    edges = found.where("edge")  # at most two rows a partition
    met = edges.groupBy("core", "name").agg(F.count(F.lit(1)).alias("n"))
    edges = edges.join(met, ["core", "name"]).where("twin or n > 1")
    single = found.where("not edge").select("doc_id", "h", "pos").unionByName(edges.select("doc_id", "h", "pos"))

    def ranged(df: DataFrame, lo, hi) -> DataFrame:
        return df.select("doc_id", "h", (F.greatest(lo, F.lit(0)).cast("long") * F.lit(1 << 32) + hi.cast("long")).alias("r"))
    every = (ranged(settled.where("twin"), F.col("pos") - REACH, F.col("pos") + LENGTH)
             .unionByName(ranged(ranges.where("tail is null"), F.col("lo"), F.col("hi")))
             .unionByName(ranged(single, F.col("pos"), F.col("pos") + LENGTH)))
    return every.groupBy("doc_id", "h").agg(F.collect_list("r").alias("gone"))


def removed_mask(size: int, gone: np.ndarray) -> np.ndarray:
    """Whether each byte of a text of ``size`` bytes lies in one of the ranges."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, gone >> 32, 1)
    np.add.at(step, np.minimum(size, gone & 0xFFFFFFFF), -1)
    return np.cumsum(step[:size]) > 0


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int, int]]:
    """(kept bytes, size, removed bytes, removed runs) of each row."""
    gone = batch.column("gone")
    for i, z in enumerate(batch.column("z").to_pylist()):
        body = _DECOMPRESS.decompress(z) if z else b""
        if not gone[i].is_valid:
            yield body, len(body), 0, 0
            continue
        mask = removed_mask(len(body), gone[i].values.to_numpy(zero_copy_only=False))
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        yield np.frombuffer(body, np.uint8)[~mask].tobytes(), len(body), int(mask.sum()), runs


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, removed, runs, hashlib.sha256(kept).hexdigest()) for kept, n, removed, runs in _cut(batch)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column("known"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of ``docs``."""
    rows = keyed(docs)
    gone = repeated_ranges(rows)
    named = texts(docs).select(F.col("doc_id").alias("known"), F.coalesce("doc_id", F.xxhash64("body")).alias("doc_id"),
                               F.hash("body").alias("h"), "body")
    packed = map_batches(named, _pack_known, "known long, doc_id long, h int, z binary")
    return map_batches(packed.join(gone, ["doc_id", "h"], "left"), _digest_rows,
                       "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _pack_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = pa.array([squeeze.compress(b) for b in batch.column("body").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("known"), batch.column("doc_id"), batch.column("h"), z],
                                         ["known", "doc_id", "h", "z"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (a character that loses a byte goes whole); a text that loses
    all becomes empty, null becomes empty; the other columns stay as they are, and so does the number of rows."""
    others = [c for c in docs.columns if c != "text"]
    gone = repeated_ranges(keyed(docs))
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    named = (docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("other"), F.col("doc_id").alias("known"), body.alias("body"))
             .select("other", F.coalesce("known", F.xxhash64("body")).alias("doc_id"), F.hash("body").alias("h"), "body"))
    other_type = named.schema["other"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([squeeze.compress(b) for b in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("other"), batch.column("doc_id"), batch.column("h"), z],
                                             ["other", "doc_id", "h", "z"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b.decode("utf-8", "ignore") for b, *_ in _cut(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("other"), pa.array(kept, pa.string())], ["other", "text"])
    packed = map_batches(named, pack, f"other {other_type}, doc_id long, h int, z binary")
    out = map_batches(packed.join(gone, ["doc_id", "h"], "left"), cut, f"other {other_type}, text string")
    return out.select(*(F.col("text") if c == "text" else F.col(f"other.`{c}`").alias(c) for c in docs.columns))
