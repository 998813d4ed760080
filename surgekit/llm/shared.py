"""Helpers shared by the training-data operators: shared-folder staging, column-safe text frames, folds."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import delete_at_exit, scratch_path, ship_package

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of one Arrow batch. Texts of a batch are cut again by bytes (``byte_chunks``), so this bounds what a
#: Python worker holds even where texts are long.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20
#: Bytes of text that one numpy pass works on.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """What the Arrow stages rely on: bounded batches and the package on the executors."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read back: lineage ends here, a lost
    executor rereads the files, and every later branch sees the same rows. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_path(spark, f'llm-{name}')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): the whole text as UTF-8 bytes, null as empty. Other columns are left out, whatever their names."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))


def binary_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a binary Arrow column without copying a value; offsets has one entry more than rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES,
                column: str = "body") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with about ``limit`` bytes; a longer text is a run of its own."""
    data, off = binary_views(batch.column(column))
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


_CACHES: list = []
_STAGE = [""]


def worker_cache(store):
    """Registers a dictionary or list that a Python worker keeps between tasks of one stage; another stage's first task empties it."""
    _CACHES.append(store)
    return store


def _enter(stage: str) -> None:
    """Workers are reused from stage to stage: what an earlier stage kept goes before another one begins."""
    if _STAGE[0] != stage:
        _STAGE[0] = stage
        for store in _CACHES:
            store.clear()
        _give_back()


def _give_back() -> None:
    """Returns freed memory to the system, which the allocators would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches; a worker's caches and freed memory don't outlive the stage."""
    prepare(df.sparkSession)
    stage = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(stage)
        yield from fn(batches)
        _give_back()
    return df.mapInArrow(run, schema)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``number``, the rows' places from 0 in ``order``. Rows are range-sorted and written once; a row's place in its
    partition plus the partition's offset (one row a partition) is its number, so no task sees more than its partition."""
    local = F.lit(1 << 33)  # monotonically_increasing_id counts within a partition below this
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    ranged = ranged.withColumn("_part", F.floor(F.col("_at") / local)).withColumn("_at", F.col("_at") % local)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn("number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
