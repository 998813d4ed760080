"""Token counts from flat token files without an index, by a separator scan.

A file is a stream of little-endian ids in which an end-of-document id follows each document; it is stored as blocks of
``BLOCK`` bytes cut without regard to documents. The scan compares a whole block with the separator at once (numpy), and
keeps of a block: its tokens, the places of its separators. Documents that cross blocks are stitched with a prefix scan:
over the blocks of a file, the tokens and separators before a block and the place of the last separator before it are
running sums and a running maximum.

``write_flat`` makes such files from documents, one for each input partition (no shuffle; a file is bounded by its
partition). doc_ids stand beside the stream, in a column of their own that the scan does not read; they are joined to the
counts by their place in the file.

Defined cases: null text counts as empty and gives 0 tokens; repeated doc_ids are counted row by row; a stream that ends
without a separator has a last document that is not ended (``ended`` false); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import encode_bodies
from .shared import map_batches, staged, texts

BLOCK = 1 << 20
ID_BYTES = 2  # ids below 65,536; see id_bytes
FLAT_SCHEMA = "file int, block int, data binary, named array<long>"
_ARROW = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("named", pa.list_(pa.int64()))])


def id_bytes(tokenizer: str, separator: int) -> int:
    """Bytes an id: 2 where every id of the tokenizer and the separator are below 65,536, else 4."""
    from tokenizers import Tokenizer
    return 2 if max(separator, *Tokenizer.from_file(tokenizer).get_vocab().values()) < 1 << 16 else 4


def write_flat(docs: DataFrame, tokenizer: str, separator: int, block_bytes: int = BLOCK, width: int = ID_BYTES) -> DataFrame:
    """Encodes documents into flat files in the shared folder, ``width`` bytes an id; returns the written blocks. ``named``
    holds the doc_ids of the documents whose encoding was finished since the block before, in order. An id that does not
    fit is an error. ``block_bytes`` is a multiple of ``width``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, names = TaskContext.get().partitionId(), 0, []
        pending = bytearray()

        def row(data: bytes) -> pa.RecordBatch:
            nonlocal block, names
            out = pa.RecordBatch.from_pylist([{"file": file, "block": block, "data": data, "named": names}], schema=_ARROW)
            block, names = block + 1, []
            return out
        for batch in batches:
            encoded = encode_bodies(tokenizer, batch.column("body"), separator)
            for doc_id, e in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids = np.frombuffer(e, "<u4")
                if int(ids.max()) >> (8 * width):
                    raise OverflowError(f"id {ids.max()} does not fit in {width} bytes")
                pending += ids.astype(f"<u{width}").tobytes()
                names.append(doc_id)
                while len(pending) >= block_bytes:
                    yield row(bytes(pending[:block_bytes]))
                    del pending[:block_bytes]
        if pending or names:
            yield row(bytes(pending))
    return staged(map_batches(texts(docs), run, FLAT_SCHEMA), "flat-tokens")


def scan(flat: DataFrame, separator: int, width: int = ID_BYTES) -> DataFrame:
    """(file, place, start, n_tokens, ended): each document of each file in order, with its first token's place in the file
    and its tokens without the separator."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(d.as_buffer(), f"<u{width}") for d in batch.column("data")]
            at = [np.flatnonzero(x == separator).astype(np.int64) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(at, pa.list_(pa.int64()))], ["file", "block", "n", "at"])
    blocks = map_batches(flat.select("file", "block", "data"), find, "file int, block int, n long, at array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .withColumn("docs", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)))
              .withColumn("last", F.when(F.size("at") > 0, F.col("offset") + F.element_at("at", -1))))
    carried = (blocks.withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
               .withColumn("final", F.max("block").over(Window.partitionBy("file")) == F.col("block")))
    ends = F.transform("at", lambda a: a + F.col("offset"))
    starts = F.concat(F.array("open"), F.transform(ends, lambda e: e + 1))
    tail = F.col("offset") + F.col("n")
    unended = F.col("final") & (F.element_at(starts, -1) < tail)
    ends = F.when(unended, F.concat(ends, F.array(tail))).otherwise(ends)
    documents = F.zip_with(F.slice(starts, F.lit(1), F.size(ends)), ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("n")))
    return (carried.select("file", "docs", unended.alias("unended"), F.size(ends).alias("size"), F.posexplode(documents).alias("i", "d"))
            .select("file", (F.col("docs") + F.col("i")).alias("place"), F.col("d.start").alias("start"), F.col("d.n").alias("n_tokens"),
                    (~(F.col("unended") & (F.col("i") == F.col("size") - 1))).alias("ended")))


def names(flat: DataFrame) -> DataFrame:
    """(file, place, doc_id) from the column beside the stream."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (flat.select("file", "block", "named").withColumn("docs", F.coalesce(F.sum(F.size("named")).over(before), F.lit(0)))
            .select("file", "docs", F.posexplode("named").alias("i", "doc_id"))
            .select("file", (F.col("docs") + F.col("i")).alias("place"), "doc_id"))


def document_counts(docs: DataFrame, tokenizer: str, separator: int) -> DataFrame:
    """(doc_id, file, place, start, n_tokens), a row for each row of ``docs``."""
    width = id_bytes(tokenizer, separator)
    flat = write_flat(docs, tokenizer, separator, width=width)
    found = scan(flat, separator, width)
    return found.join(names(flat), ["file", "place"]).select("doc_id", "file", "place", "start", "n_tokens")
