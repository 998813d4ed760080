"""Structured Streaming forms of the ingest / rollup / polling operators.

The reference has no engine-level streaming; these are re-aimings with our own late-data rule: rows
older than the watermark are dropped. Every query checkpoints into the shared checkpoint folder, so a
restarted or re-planned query resumes exactly once from its file-source log.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import keep_latest
from ..session import checkpoint_dir, path_exists
from ..sources.pointers import listing, pointers, publish, remove


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """File-source stream (landed files); the schema is fixed, never inferred."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, watermark: str = "1 day") -> DataFrame:
    """S04 streaming: drop repeated keys seen within the watermark (state is bounded by the watermark)."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def daily_rollup_stream(stream: DataFrame, ts: str, keys: Sequence[str], value: str,
                        watermark: str = "1 hour") -> DataFrame:
    """A03 streaming: event-time daily windows per key; partial aggregates live in the state store."""
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, "1 day").alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum(value).alias("total_value"),
                 F.max(value).alias("max_value"))
            .select(F.to_date(F.col("w.start")).alias("metric_date"), *keys, "n_events", "total_value", "max_value"))


def upsert_log_writer(path: str, keys: Sequence[str]):
    """foreachBatch sink for update-mode aggregates: append every batch's changed rows tagged with the
    batch id; readers take the latest row per key (``read_upsert_log``). Idempotent per batch id:
    a replayed batch rewrites its own sub-directory."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id))
              .write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}")))
    return write


def read_upsert_log(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    d = spark.read.parquet(path)
    return keep_latest(d, keys, ["batch"]).drop("batch", "_batch")


def run_available_now(df: DataFrame, name: str, mode: str, sink_path: str | None = None,
                      foreach_batch=None) -> str:
    """Run a streaming query over everything available, then stop (checkpoint in the shared folder)."""
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    ck = os.path.join(base, "streams", name)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").option("path", sink_path).start()
    q.awaitTermination()
    return ck


# --- I05: high-water-mark incremental ingest as a stream ------------------------------------------

def hwm_batch_writer(marks_path: str, out_path: str, key: str, ts: str):
    """foreachBatch: load only records newer than each entity's mark, append them, and write what the batch adds to the
    marks. A batch sees the marks of earlier batches alone (``batch < batch_id``; seeds are batch -1), never its own, so a
    replayed batch finds the same records again and rewrites the same two directories."""
    from ..operators.control import high_water_marks, incremental_slice

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, marks_path):
            versions = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, last_video_published_at timestamp, "
                                         "batch int").parquet(marks_path)
            marks = versions.where(F.col("batch") < batch_id).groupBy(key).agg(
                F.max("last_video_published_at").alias("last_video_published_at"))
            new = incremental_slice(batch, marks, key, ts)
        else:  # no marks yet: everything is new
            new = batch
        new.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))
        high_water_marks(new, key, ts).write.mode("overwrite").parquet(os.path.join(marks_path, f"batch={batch_id}"))
    return write


# --- I07 / M16: snapshot polling, early signals ----------------------------------------------------

SIGNAL_HOURS = (6, 24, 48)


def early_signal_batch_writer(state_root: str, key: str, ts: str, compact_every: int | None = None):
    """foreachBatch: append the batch's polls, counted per (key, poll time), as ``batch=<batch_id>``.

    The state is this log. Counts relative to an entity's first poll can't be kept ready-made, because a late poll may move
    the first poll back and with it every limit; poll times can, whatever order they come in. A replayed batch rewrites its
    own directory, or nothing once a published compaction holds it; a hot entity's polls are pre-counted in every map task.
    With ``compact_every`` the log is compacted after every so many batches, and superseded files go one compaction later."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= max(pointers(spark, state_root), default=-1):
            return
        (batch.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
              .groupBy("key", "ts").agg(F.count(F.lit(1)).alias("n"))
              .write.mode("overwrite").parquet(os.path.join(state_root, f"batch={batch_id}")))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_early_signals(spark, state_root)
            expire_polls(spark, state_root, keep=2)
    return write


def _batches(spark: SparkSession, state_root: str) -> list[int]:
    """The log's finished batches."""
    found = [int(n.split("=")[1]) for n in listing(spark, state_root) if n.startswith("batch=")]
    return sorted(b for b in found if path_exists(spark, f"{state_root}/batch={b}/_SUCCESS"))


def read_polls(spark: SparkSession, state_root: str, version: int | None = None, upto: int | None = None) -> DataFrame:
    """(key, ts, n): the polls of a version's base (the latest one's by default) and of the finished batches after it, up to ``upto``.
    The files are fixed when this is called: a compaction that is published meanwhile changes nothing for this reader, whose files
    stay until ``expire_polls`` drops their version."""
    taken = pointers(spark, state_root)
    if version is None:
        version = max(taken, default=-1)
    paths = [f"{state_root}/{taken[version]}"] if version >= 0 else []
    paths += [f"{state_root}/batch={b}" for b in _batches(spark, state_root) if b > version and (upto is None or b <= upto)]
    schema = "key long, ts timestamp, n long"
    polls = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return polls.groupBy("key", "ts").agg(F.sum("n").alias("n"))


def compact_early_signals(spark: SparkSession, state_root: str) -> int:
    """Folds the published base and all finished batches into a new base that gives the same signals, publishes it and returns its
    version, the last batch it holds (-1: nothing to fold). Poll times up to the last limit after the first poll stay as they are, all
    later ones become a single count at the last poll; a first poll can only move back, so a poll beyond the last limit stays beyond
    it. A key thus keeps its polls of the first 48 hours and one row more.

    The base is written under a name of its own and takes its place by its pointer, set last: a compaction that stops before leaves
    the log as it was. One compaction runs at a time, beside any number of readers and the stream's own writer."""
    taken = max(pointers(spark, state_root), default=-1)
    upto = max(_batches(spark, state_root), default=-1)
    if upto <= taken:
        return taken
    polls = read_polls(spark, state_root, upto=upto)
    first = polls.groupBy("key").agg(F.min("ts").alias("t0"), F.max("ts").alias("last"))
    far = (F.unix_micros("ts") - F.unix_micros("t0")) > SIGNAL_HOURS[-1] * 3600 * 10 ** 6
    kept = polls.join(first, "key").withColumn("ts", F.when(far, F.col("last")).otherwise(F.col("ts")))
    body = f"base-{uuid.uuid4().hex}"
    kept.groupBy("key", "ts").agg(F.sum("n").alias("n")).write.parquet(f"{state_root}/{body}")
    publish(spark, state_root, upto, body)
    return upto


def expire_polls(spark: SparkSession, state_root: str, keep: int = 1) -> None:
    """Drops what the ``keep`` latest versions don't need: batches that the oldest of them holds, older versions with their bases, and
    bases that were never published and are older than the latest pointer. Readers of a dropped version must have ended."""
    taken, names = pointers(spark, state_root), listing(spark, state_root)
    kept = sorted(taken)[-keep:]
    if not kept:
        return
    newest = names[f"current-{kept[-1]:09d}-{taken[kept[-1]]}"]
    doomed = [f"current-{v:09d}-{taken[v]}" for v in taken if v not in kept]   # pointers first: nothing names what goes next
    doomed += [n for n in names if n.startswith("base-") and n not in {taken[v] for v in kept} and (n in taken.values() or names[n] < newest)]
    doomed += [n for n in names if n.startswith("batch=") and int(n.split("=")[1]) <= kept[0]]
    for n in doomed:
        remove(spark, f"{state_root}/{n}")


def read_early_signals(spark: SparkSession, state_root: str, version: int | None = None) -> DataFrame:
    """Early-signal rows from all polls of the log: polls, polls within 6 / 24 / 48 h of the first one, age of the series."""
    polls = read_polls(spark, state_root, version)
    first = polls.groupBy("key").agg(F.min("ts").alias("t0"), F.max("ts").alias("last"))
    age = F.unix_micros("ts") - F.unix_micros("t0")
    within = [F.sum(F.when(age <= h * 3600 * 10 ** 6, F.col("n")).otherwise(0)).alias(f"e{i}_views_{h}h")
              for i, h in enumerate(SIGNAL_HOURS, 1)]
    return (polls.join(first, "key").groupBy("key").agg(F.min("t0").alias("t0"), F.sum("n").alias("v7_views_at_poll"), *within,
                                                        F.max("last").alias("last"))
            .withColumn("v8_age_hours", (F.unix_micros("last") - F.unix_micros("t0")) / F.lit(3600e6)).drop("last"))


__all__ = ["read_stream", "dedup_stream", "daily_rollup_stream", "upsert_log_writer", "read_upsert_log",
           "run_available_now", "hwm_batch_writer", "early_signal_batch_writer", "compact_early_signals",
           "expire_polls", "read_polls", "read_early_signals", "keep_latest"]
