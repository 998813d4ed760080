"""Layers partitioned by month (``io.materialize_layer``), read by date and merged in place.

``_part`` is the first day of the month of a row's date, so a range of dates implies a range of partitions: ``scan_dates`` says so to
the scan, which then lists those directories only, and ``merge_layer`` rewrites no others."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import keep_latest, unique_by
from ..session import delete_at_exit, scratch_path
from .pointers import remove

PART, NO_DATE = "_part", "__HIVE_DEFAULT_PARTITION__"


def scan_dates(spark: SparkSession, path: str, date_col: str, low: date | datetime, high: date | datetime) -> DataFrame:
    """The layer's rows with ``low`` <= date < ``high``, read from the months that can hold any. Rows without a date are in no range."""
    first, last = (F.trunc(F.lit(d).cast("date"), "MM") for d in (low, high))
    rows = spark.read.parquet(path).where(F.col(PART).between(first, last))
    return rows.where((F.col(date_col) >= F.lit(low)) & (F.col(date_col) < F.lit(high))).drop(PART)


def _months(df: DataFrame) -> set[date | None]:
    """Distinct months of a relation: as many rows as the layer has directories."""
    return {r[0] for r in df.select(PART).distinct().collect()}


def merge_layer(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], date_col: str,
                update_cols: Sequence[str] | None = None, order_cols: Sequence[str] | None = None) -> set[date | None]:
    """I01 on a layer: rows of the source replace the layer's rows of the same key (``update_cols``: only these columns; the others keep
    the layer's value), new keys are inserted, and only the months that lose, change or gain a row are rewritten. Returns them.

    A key that repeats in the source is an error unless ``order_cols`` says which row counts. A row whose date changes moves to its new
    month. Rows without a date live in a partition of their own; null keys match nothing and are inserted. An empty source changes
    nothing. Months are replaced one after another: a merge that stops half-way is mended by running it again, since a key found in
    two months counts once, with its latest date."""
    keys = list(keys)
    names = [c for c in spark.read.parquet(path).columns if c != PART]
    layer = spark.read.parquet(path)
    held = f"{scratch_path(spark, 'merge')}-{uuid.uuid4().hex}"
    (keep_latest(source, keys, order_cols) if order_cols else unique_by(source, keys)).write.parquet(f"{held}/source")
    delete_at_exit(spark, held)
    src = spark.read.parquet(f"{held}/source")
    if date_col in keys or update_cols is None or date_col in update_cols:
        gains = src.select(F.trunc(date_col, "MM").alias(PART))
    else:  # a new row without a date of its own goes to the partition for these
        gains = src.join(layer.select(*keys), keys, "left_anti").select(F.lit(None).cast("date").alias(PART))
    months = _months(layer.join(src.select(*keys), keys, "left_semi").select(PART).unionByName(gains))
    if not months:
        return months
    known = [m for m in months if m is not None]
    hit = F.col(PART).isin(known) if known else F.lit(False)
    touched = layer.where(hit | F.col(PART).isNull()) if None in months else layer.where(hit)
    stay = touched.join(src.select(*keys), keys, "left_anti").select(*names)
    if update_cols is None:
        rows = src.select(*names)
    else:
        old = keep_latest(touched.join(src.select(*keys), keys, "left_semi").select(*names), keys, [date_col])
        new = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in update_cols])
        rows = new.join(old, keys, "left").select(*[F.col(f"_s_{c}").alias(c) if c in update_cols else F.col(c) for c in names])
    merged = stay.unionByName(rows).withColumn(PART, F.trunc(date_col, "MM"))
    merged.repartitionByRange(PART, *keys).sortWithinPartitions(PART, *keys).write.partitionBy(PART).parquet(f"{held}/merged")
    ready = spark.read.schema(merged.schema).parquet(f"{held}/merged")
    filled = _months(ready)
    (ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path))
    for m in months - filled:  # every row of the month has moved
        remove(spark, f"{path}/{PART}={m.isoformat() if m is not None else NO_DATE}")
    return months
