"""Fixture adapter: the driver's TPC-H-like tables -> the item / owner shape the operators need.

items  (one row per order)    = typed staging output for "videos"
owners (one row per customer) = typed staging output for "channels"

Every column is a deterministic function of the given tables, so the work grows with them.
The same definitions exist as DuckDB SQL in ``surgekit.plans.oracle`` for the oracle check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed fixture parameters (shared with the SQL oracle)
AS_OF = "2001-08-02"              # one day past the last order date
CRAWLED_AT = "2001-08-02 06:00:00"
CHANNEL_EPOCH = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _duration_text(k) -> F.Column:
    """'PT..H..M..S' text with optional pieces; every 101st key carries a day part."""
    s = (k * 7919) % 5400
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    pieces = F.concat(
        F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(F.lit("")),
        F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(F.lit("")),
        F.when((sec > 0) | (s == 0), F.concat(sec.cast("string"), F.lit("S"))).otherwise(F.lit("")))
    return F.when(k % 101 == 0, F.concat(F.lit("P1DT"), pieces)).otherwise(F.concat(F.lit("PT"), pieces))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items. Lineitems are pre-aggregated per order (map-side combine) before the join."""
    o = table(spark, sf_dir, "orders")
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("_q"), F.count("l_orderkey").alias("_n")))
    k = F.col("o_orderkey")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    return j.select(
        k.alias("video_id"),
        F.col("o_custkey").alias("channel_id"),
        F.concat_ws(" ", F.col("o_orderpriority"), F.lit("order"), k.cast("string"),
                    F.when(k % 7 == 0, F.lit("?")), F.when(k % 11 == 0, F.lit("!"))).alias("title"),
        F.col("o_orderstatus").alias("description"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit('["'), F.col("o_orderstatus"), F.lit('","'), F.col("o_orderpriority"),
                             F.lit('"]'))).alias("tags"),
        F.substring("o_orderpriority", 1, 1).alias("category_id"),
        F.lit("en").alias("default_language"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("published_at"),
        F.floor("o_totalprice").cast("bigint").alias("view_count"),
        F.coalesce(F.col("_q"), F.lit(0)).cast("bigint").alias("like_count"),
        F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("comment_count"),
        _duration_text(k).alias("duration_iso8601"),
        (k % 3 == 0).alias("has_caption"),
        F.when(k % 4 == 0, F.lit("sd")).otherwise(F.lit("hd")).alias("definition"),
        F.lit("public").alias("privacy_status"),
        (k % 5 != 0).alias("is_embeddable"),
        (k % 10 == 0).alias("is_made_for_kids"),
        F.lit(CRAWLED_AT).cast("timestamp").alias("crawled_at"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ⋈ nation as owners. nation is the fixed 25-row TPC-H dimension, so broadcasting it
    is bounded by construction."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias("channel_id"),
                    F.col("c_name").alias("channel_name"),
                    F.col("n_name").alias("country_code"),
                    F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("bigint").alias("subscriber_count"),
                    F.date_sub(F.lit(CHANNEL_EPOCH).cast("date"), (F.col("c_custkey") % 1000).cast("int"))
                     .cast("timestamp").alias("channel_created_at"),
                    F.col("c_mktsegment").alias("segment"),
                    F.lit(CRAWLED_AT).cast("timestamp").alias("crawled_at")))


def control_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channels_config rows from customers: frequency, status, last/next run, activity and priority are
    deterministic functions of the customer key and balance."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    asof = F.lit(AS_OF).cast("timestamp")
    last = F.when(k % 7 == 0, F.lit(None).cast("timestamp")).otherwise(
        asof - F.make_dt_interval(hours=(k % 96).cast("int")))
    freq = F.when(k % 3 == 0, F.lit(12)).when(k % 3 == 1, F.lit(24)).otherwise(F.lit(48))
    subs = F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 1000)
    from ..functions.exprs import crawl_priority
    return c.select(
        k.alias("channel_id"), F.col("c_name").alias("channel_name"), freq.alias("crawl_frequency_hours"),
        F.when(k % 11 == 0, F.lit("failed")).when(k % 7 == 0, F.lit("pending")).otherwise(F.lit("success"))
         .alias("crawl_status"),
        last.alias("last_crawl_ts"),
        F.coalesce(last + F.make_dt_interval(hours=freq), asof - F.make_dt_interval(hours=F.lit(1)))
         .alias("next_crawl_ts"),
        F.lit(None).cast("timestamp").alias("last_video_published_at"),
        (k % 13 != 0).alias("is_active"),
        crawl_priority(subs).alias("priority"),
        (k % 2 == 0).alias("include_comments"),
        (F.lit("2001-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 200).cast("int"))).alias("created_at"),
        asof.alias("updated_at"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crawl_log rows from events: one run per event, 'error' events are failed runs."""
    e = table(spark, sf_dir, "events")
    err = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("channel_id"),
        F.col("ts").cast("timestamp").alias("crawl_ts"),
        F.floor("value").cast("int").alias("records_fetched"),
        F.when(err, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(err, F.concat(F.lit("error "), F.col("props"))).alias("error_msg"),
        (F.col("value") / 10).alias("execution_time_seconds"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("batch_id"))
