"""Catalog entries for the streaming operators: each runs a Structured Streaming query over the events
table with ``trigger(availableNow=True)`` into a sink under the shared checkpoint folder and returns the
sink read back as a DataFrame."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir, delete_at_exit
from ..sources import fixtures as fx
from ..streaming import streams as S
from .catalog import register


def _events_stream(spark, sf):
    """The events file as a file-source stream (a one-file glob: the source needs a directory base);
    event time cast to TIMESTAMP (watermarks require it)."""
    schema = fx.table(spark, sf, "events").schema
    s = S.read_stream(spark, f"{sf.rstrip('/')}/event[s].parquet", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _scattered_stream(spark, sf, batches):
    """The events as a stream of about ``batches`` micro-batches, each with events of all days: the rows are written in files by the hash
    of their id, and a trigger takes its share of the files."""
    path = _scratch(spark, "scattered")
    ev = fx.table(spark, sf, "events")
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ev.repartition(files, "event_id").write.parquet(path)
    delete_at_exit(spark, path)
    written = len(spark.read.parquet(path).inputFiles())
    s = S.read_stream(spark, path, ev.schema, max_files=max(1, -(-written // batches)))
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), "stream-out", f"{name}-{uuid.uuid4().hex[:12]}")


@register("st1_stream_daily_rollup", """
SELECT CAST(ts AS DATE) AS metric_date, event_type, count(*) AS n_events, sum(value) AS total_value,
  max(value) AS max_value FROM events GROUP BY 1, 2""", ["total_value", "max_value"])
def q_st1(spark, sf):
    """A03 streaming: event-time daily windows with a watermark, update mode into an upsert log."""
    out = _scratch(spark, "rollup")
    agg = S.daily_rollup_stream(_events_stream(spark, sf), "ts", ["event_type"], "value")
    S.run_available_now(agg, os.path.basename(out), "update",
                        foreach_batch=S.upsert_log_writer(out, ["metric_date", "event_type"]))
    return S.read_upsert_log(spark, out, ["metric_date", "event_type"])


@register("st2_stream_dedup")
def q_st2(spark, sf):
    """S04 streaming: drop repeated (user, event type) keys within a one-day watermark."""
    out = _scratch(spark, "dedup")
    d = S.dedup_stream(_events_stream(spark, sf), ["user_id", "event_type"], "ts", "1 day")
    S.run_available_now(d, os.path.basename(out), "append", sink_path=out)
    return spark.read.parquet(out)


SIGNALS_SQL = """
WITH f AS (SELECT user_id, min(ts) AS t0, max(ts) AS tl FROM events GROUP BY user_id),
d AS (SELECT e.user_id, (epoch_us(e.ts) - epoch_us(f.t0)) / 3600e6 AS age FROM events e JOIN f ON e.user_id = f.user_id)
SELECT f.user_id AS key, f.t0, count(*) AS v7_views_at_poll,
  CAST(sum(CASE WHEN age <= 6 THEN 1 ELSE 0 END) AS BIGINT) AS e1_views_6h,
  CAST(sum(CASE WHEN age <= 24 THEN 1 ELSE 0 END) AS BIGINT) AS e2_views_24h,
  CAST(sum(CASE WHEN age <= 48 THEN 1 ELSE 0 END) AS BIGINT) AS e3_views_48h,
  (epoch_us(f.tl) - epoch_us(f.t0)) / 3600e6 AS v8_age_hours
FROM d JOIN f ON d.user_id = f.user_id GROUP BY f.user_id, f.t0, f.tl"""


@register("st4_stream_hwm_ingest", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15'
  OR ts > (SELECT max(ts) FROM events e2 WHERE e2.user_id = events.user_id AND e2.ts < TIMESTAMP '2024-01-15')
  OR NOT EXISTS (SELECT 1 FROM events e3 WHERE e3.user_id = events.user_id AND e3.ts < TIMESTAMP '2024-01-15')""",
          ["value"])
def q_st4(spark, sf):
    """I05 streaming: records newer than each entity's high-water mark (marks seeded from events before
    Jan 15), marks advanced per micro-batch via foreachBatch."""
    base = _scratch(spark, "hwm")
    marks, out = os.path.join(base, "marks"), os.path.join(base, "out")
    ev = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seed = ev.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).groupBy("user_id").agg(
        F.max("ts").alias("last_video_published_at"))
    seed.write.mode("overwrite").parquet(os.path.join(marks, "batch=-1"))
    S.run_available_now(_events_stream(spark, sf), os.path.basename(base), "append",
                        foreach_batch=S.hwm_batch_writer(marks, out, "user_id", "ts"))
    return spark.read.parquet(out).drop("batch")


@register("st5_stream_early_signals_additive", SIGNALS_SQL, ["v8_age_hours"])
def q_st5(spark, sf):
    """I07 + M16 streaming: the polls of each micro-batch are appended to a log of (entity, poll time, count) via
    foreachBatch, which compacts the log after every second batch; the batches hold events of all days, so polls come late."""
    log = os.path.join(_scratch(spark, "signals-add"), "log")
    S.run_available_now(_scattered_stream(spark, sf, 4), os.path.basename(os.path.dirname(log)), "append",
                        foreach_batch=S.early_signal_batch_writer(log, "user_id", "ts", compact_every=2))
    return S.read_early_signals(spark, log)
