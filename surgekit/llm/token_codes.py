"""Token files of directly addressable codes.

An id is cut into chunks of ``WIDTH`` bits, lowest first. Level 0 holds the first chunk of every id; a bitmap tells which
ids continue, and level 1 holds the second chunk of those alone, and so on. A rank directory (continuing ids before each
block of ``RANK_BITS``) gives the place of an id's chunk on the next level, so any token is read with a few lookups and
without decoding a block.

Documents are range-partitioned and sorted by doc_id, so the files of ascending partitions hold ascending documents. A
partition is written as segments (rows of a Parquet file, some ``SEGMENT`` tokens each, never splitting a document): doc_ids,
token counts, levels, bitmaps, rank directories. A document's global start is its place in the partition plus the tokens of
earlier partitions, from a table with one row a partition.

Defined cases: null text counts as empty and encodes to the end id alone; null doc_ids come first; rows with equal doc_ids
are kept, in order of their text's hash; an empty table gives an empty file; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encode_bodies
from .shared import map_batches, staged, texts

WIDTH, RANK_BITS, SEGMENT = 8, 512, 1 << 20
SEGMENT_SCHEMA = ("part int, segment int, start long, n_tokens long, doc_ids array<long>, counts array<long>, "
                  "levels array<binary>, bitmaps array<binary>, ranks array<binary>")


@dataclass(frozen=True)
class Codes:
    """One segment's levels, continuation bitmaps (of all levels but the last) and rank directories."""
    levels: list[np.ndarray]
    bitmaps: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, bitmaps, ranks = [], [], []
        rest = ids.astype(np.uint32)
        while True:
            levels.append((rest & np.uint32((1 << WIDTH) - 1)).astype(np.uint8))
            rest = rest >> np.uint32(WIDTH)
            goes_on = rest > 0
            if not goes_on.any():
                return cls(levels, bitmaps, ranks)
            bitmaps.append(np.packbits(goes_on, bitorder="little"))
            blocks = np.add.reduceat(goes_on.astype(np.uint32), np.arange(0, len(rest), RANK_BITS))
            ranks.append(np.concatenate(([0], np.cumsum(blocks)[:-1])).astype(np.uint32))
            rest = rest[goes_on]

    def __len__(self) -> int:
        return len(self.levels[0])

    def token(self, i: int) -> int:
        """The id at place ``i``, from one chunk a level."""
        value = 0
        for level, chunks in enumerate(self.levels):
            value |= int(chunks[i]) << (WIDTH * level)
            if level == len(self.bitmaps) or not (self.bitmaps[level][i >> 3] >> (i & 7)) & 1:
                break
            block = i // RANK_BITS
            before = np.unpackbits(self.bitmaps[level][block * RANK_BITS // 8:(i >> 3) + 1], bitorder="little")[:i - block * RANK_BITS]
            i = int(self.ranks[level][block]) + int(before.sum())
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        ids = self.levels[-1].astype(np.uint32)
        for chunks, bitmap in zip(self.levels[-2::-1], self.bitmaps[::-1], strict=True):
            high = np.zeros(len(chunks), np.uint32)
            high[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] = ids
            ids = chunks | (high << np.uint32(WIDTH))
        return ids

    def blobs(self) -> tuple[list[bytes], list[bytes], list[bytes]]:
        return tuple([x.tobytes() for x in part] for part in (self.levels, self.bitmaps, self.ranks))

    @classmethod
    def from_blobs(cls, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> Codes:
        return cls([np.frombuffer(x, np.uint8) for x in levels], [np.frombuffer(x, np.uint8) for x in bitmaps],
                   [np.frombuffer(x, np.uint32) for x in ranks])


def write_codes(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Encodes all documents into segments in the shared folder and returns the written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        ids: list = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, start
            counts = [len(h) // 4 for h in held]
            codes = Codes.of(np.frombuffer(b"".join(held), "<u4"))
            row = {"part": part, "segment": segment, "start": start, "n_tokens": sum(counts), "doc_ids": list(ids), "counts": counts}
            row["levels"], row["bitmaps"], row["ranks"] = codes.blobs()
            segment, start = segment + 1, start + row["n_tokens"]
            held.clear()
            ids.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)
        size = 0
        for batch in batches:
            encoded = encode_bodies(tokenizer, batch.column("body"), end, special=True)
            for doc_id, e in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                if held and size + len(e) > 4 * SEGMENT:
                    yield flush()
                    size = 0
                held.append(e)
                ids.append(doc_id)
                size += len(e)
        if held:
            yield flush()
    rows = texts(docs).withColumn("h", F.xxhash64("body"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "body")
    return staged(map_batches(ordered, run, SEGMENT_SCHEMA), "token-codes")


_LONGS, _BLOBS = pa.list_(pa.int64()), pa.list_(pa.binary())
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", _LONGS),
                    ("counts", _LONGS), ("levels", _BLOBS), ("bitmaps", _BLOBS), ("ranks", _BLOBS)])


def with_offsets(segments: DataFrame) -> DataFrame:
    """Adds each segment's global offset. The window runs over one row a partition."""
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return segments.join(F.broadcast(before), "part").withColumn("offset", F.col("before") + F.col("start"))


def read_back(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                data = Codes.from_blobs(r["levels"], r["bitmaps"], r["ranks"]).decode().astype("<u4").tobytes()
                ends = np.cumsum(r["counts"])
                starts = ends - np.array(r["counts"])
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["offset"]), pa.array(r["counts"], pa.int64()),
                     pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    rows = with_offsets(segments).select("doc_ids", "counts", "levels", "bitmaps", "ranks", "offset")
    return map_batches(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(segments: DataFrame, places: DataFrame) -> DataFrame:
    """(place, token) for global token places, by random access into the segments that hold them."""
    spans = with_offsets(segments)
    size = F.lit(SEGMENT)
    near = spans.select("part", "segment", "offset", "n_tokens", F.explode(F.sequence(
        F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.greatest("n_tokens", F.lit(1)) - 1) / size))).alias("cell"))
    hit = (places.where("place is not null").withColumn("cell", F.floor(F.col("place") / size)).join(near, "cell")
           .where((F.col("place") >= F.col("offset")) & (F.col("place") < F.col("offset") + F.col("n_tokens")))
           .groupBy("part", "segment", "offset").agg(F.collect_list("place").alias("places")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                codes = Codes.from_blobs(r["levels"], r["bitmaps"], r["ranks"])
                yield pa.RecordBatch.from_arrays([pa.array(r["places"], pa.int64()), pa.array(
                    [codes.token(p - r["offset"]) for p in r["places"]], pa.int64())], ["place", "token"])
    rows = segments.join(hit, ["part", "segment"]).select("levels", "bitmaps", "ranks", "offset", "places")
    return map_batches(rows, run, "place long, token long")
