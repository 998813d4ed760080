"""Catalog entries for the generic operators (dedup, ingest, diff, reconcile, top-k, control tables,
labels and label quality). Each Spark query has a DuckDB SQL twin written independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import labels as L
from ..operators import tables as T
from ..sources import fixtures as fx
from .catalog import base, register
from .oracle import with_ctes

ASOF_TS = "TIMESTAMP '2001-08-02 00:00:00'"

# ------------------------------------------------------------------------------------------------
# Dedup and keyed ingest over the events stream table
# ------------------------------------------------------------------------------------------------


@register("w01_dedup_keep_latest", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""", ["value"])
def q_w01(spark, sf):
    """W01 keep the latest row per key (aggregate form, skew-safe)."""
    return T.keep_latest(fx.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


_SNAP_KEYS = ["user_id", "event_type", "snapshot_date"]


def _snapshots(spark, sf):
    return fx.table(spark, sf, "events").withColumn("snapshot_date", F.to_date("ts"))


@register("s04_skip_if_exists", """
WITH tgt AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS snapshot_date FROM events
             WHERE ts < TIMESTAMP '2024-01-20'),
inc AS (SELECT *, CAST(ts AS DATE) AS snapshot_date FROM events WHERE ts >= TIMESTAMP '2024-01-10'),
first_rows AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, snapshot_date ORDER BY ts, event_id) AS rn
  FROM inc) WHERE rn = 1)
SELECT f.* FROM first_rows f
WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.user_id = f.user_id AND t.event_type = f.event_type
                  AND t.snapshot_date = f.snapshot_date)""", ["value"])
def q_s04(spark, sf):
    """S04 skip-if-exists ingest: batch (ts >= Jan 10) against target (ts < Jan 20), first row per key."""
    s = _snapshots(spark, sf)
    target = s.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    incoming = s.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return T.skip_if_exists(incoming, target, _SNAP_KEYS, order_cols=["ts", "event_id"], keep="first")


@register("j08_existing_keys", """
SELECT DISTINCT o_custkey AS channel_id FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_j08(spark, sf):
    """J08 / P14 key-list predicate as a semi-join: owners with items that are in a candidate list."""
    cand = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("channel_id"))
    tgt = fx.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("channel_id"))
    return T.existing_keys(cand, tgt, ["channel_id"])


# ------------------------------------------------------------------------------------------------
# U01 version diff, A04 + J09 reconciliation (a table vs a deterministic perturbation of it)
# ------------------------------------------------------------------------------------------------

_DIFF_A = """
a AS (SELECT metric_date, channel_id, videos_published, total_views, total_likes, total_comments,
             round(avg_engagement_score, 0) AS avg_engagement_score FROM daily),
b AS (SELECT metric_date, channel_id, videos_published,
             total_views + CASE WHEN channel_id % 17 = 0 THEN 1 ELSE 0 END AS total_views,
             total_likes, total_comments, avg_engagement_score FROM a)"""


def _diff_frames(spark, sf):
    d = base(spark, sf)["daily"]
    a = d.select("metric_date", "channel_id", "videos_published", "total_views", "total_likes", "total_comments",
                 F.round("avg_engagement_score", 0).alias("avg_engagement_score"))
    b = a.withColumn("total_views", F.col("total_views") + F.when(F.col("channel_id") % 17 == 0, 1).otherwise(0))
    return a, b


@register("u01_version_diff", with_ctes("daily", extra=_DIFF_A) + """
SELECT *, 'a_minus_b' AS diff_source FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL
SELECT *, 'b_minus_a' AS diff_source FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", ["avg_engagement_score"])
def q_u01(spark, sf):
    """U01 symmetric difference of two versions of the daily rollup."""
    a, b = _diff_frames(spark, sf)
    return T.symmetric_diff(a, b)


_RECON = """
ra AS (SELECT channel_id, category_id, CAST(sum(view_count) AS BIGINT) AS total_views,
              CAST(sum(like_count) AS BIGINT) AS total_likes, CAST(sum(comment_count) AS BIGINT) AS total_comments,
              count(*) AS n_items
       FROM fact GROUP BY channel_id, category_id),
rb AS (SELECT channel_id, category_id,
              total_views + CASE WHEN channel_id % 17 = 0 OR channel_id % 7 = 3 THEN 1 ELSE 0 END AS total_views,
              total_likes + CASE WHEN channel_id % 7 = 3 THEN 2 ELSE 0 END AS total_likes,
              total_comments + CASE WHEN channel_id % 23 = 0 OR channel_id % 7 = 3 THEN 1 ELSE 0 END AS total_comments,
              n_items + CASE WHEN channel_id % 7 = 3 THEN 1 ELSE 0 END AS n_items
       FROM ra WHERE channel_id % 19 <> 0),
rj AS (SELECT coalesce(ra.channel_id, rb.channel_id) AS channel_id, coalesce(ra.category_id, rb.category_id) AS category_id,
              ra.total_views AS a_total_views, ra.total_likes AS a_total_likes, ra.total_comments AS a_total_comments,
              ra.n_items AS a_n_items,
              rb.total_views AS b_total_views, rb.total_likes AS b_total_likes, rb.total_comments AS b_total_comments,
              rb.n_items AS b_n_items
       FROM ra FULL OUTER JOIN rb ON ra.channel_id = rb.channel_id AND ra.category_id = rb.category_id)"""

_FLAGS = """, a_total_views IS DISTINCT FROM b_total_views AS diff_total_views,
  a_total_likes IS DISTINCT FROM b_total_likes AS diff_total_likes,
  a_total_comments IS DISTINCT FROM b_total_comments AS diff_total_comments,
  a_n_items IS DISTINCT FROM b_n_items AS diff_n_items"""

_MEASURES = ["total_views", "total_likes", "total_comments", "n_items"]


def _recon_frames(spark, sf):
    f = base(spark, sf)["fact"]
    a = f.groupBy("channel_id", "category_id").agg(
        F.sum("view_count").alias("total_views"), F.sum("like_count").alias("total_likes"),
        F.sum("comment_count").alias("total_comments"), F.count(F.lit(1)).alias("n_items"))
    k = F.col("channel_id")
    whole = k % 7 == 3                            # owners whose every measure differs
    b = (a.where(k % 19 != 0)
          .withColumn("total_views", F.col("total_views") + F.when((k % 17 == 0) | whole, 1).otherwise(0))
          .withColumn("total_likes", F.col("total_likes") + F.when(whole, 2).otherwise(0))
          .withColumn("total_comments", F.col("total_comments") + F.when((k % 23 == 0) | whole, 1).otherwise(0))
          .withColumn("n_items", F.col("n_items") + F.when(whole, 1).otherwise(0)))
    return a, b


@register("a04_j09_reconcile_any", with_ctes("fact", extra=_RECON) + "SELECT *" + _FLAGS + """ FROM rj
WHERE a_total_views IS DISTINCT FROM b_total_views OR a_total_likes IS DISTINCT FROM b_total_likes
   OR a_total_comments IS DISTINCT FROM b_total_comments OR a_n_items IS DISTINCT FROM b_n_items""")
def q_j09_any(spark, sf):
    """A04 + J09 reconciliation, report a row when any measure differs or it is one-sided."""
    a, b = _recon_frames(spark, sf)
    return T.reconcile(a, b, ["channel_id", "category_id"], _MEASURES, mode="any")


@register("j09_reconcile_all", with_ctes("fact", extra=_RECON) + "SELECT *" + _FLAGS + """ FROM rj
WHERE coalesce(a_total_views <> b_total_views AND a_total_likes <> b_total_likes
   AND a_total_comments <> b_total_comments AND a_n_items <> b_n_items, false)""")
def q_j09_all(spark, sf):
    """J09 faithful mode: a row is reported only when every measure differs (one-sided rows vanish)."""
    a, b = _recon_frames(spark, sf)
    return T.reconcile(a, b, ["channel_id", "category_id"], _MEASURES, mode="all")


@register("u03_union_relations", """
SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region_key, NULL::DOUBLE AS balance,
       'nation' AS source_relation FROM nation
UNION ALL
SELECT s_suppkey, s_name, NULL, s_acctbal, 'supplier' FROM supplier""", ["balance"])
def q_u03(spark, sf):
    """U02 / U03 union of relations by name with missing columns as NULL and a source tag."""
    n = fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"),
                                           F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_key"))
    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                                             F.col("s_acctbal").alias("balance"))
    return T.union_relations({"nation": n, "supplier": s})


# ------------------------------------------------------------------------------------------------
# top-k and control tables
# ------------------------------------------------------------------------------------------------

CONTROL_SQL = f"""
ctl AS (
  SELECT c_custkey AS channel_id, c_name AS channel_name,
    CASE WHEN c_custkey % 3 = 0 THEN 12 WHEN c_custkey % 3 = 1 THEN 24 ELSE 48 END AS crawl_frequency_hours,
    CASE WHEN c_custkey % 11 = 0 THEN 'failed' WHEN c_custkey % 7 = 0 THEN 'pending' ELSE 'success' END AS crawl_status,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {ASOF_TS} - to_hours(CAST(c_custkey % 96 AS INTEGER)) END AS last_crawl_ts,
    c_custkey % 13 <> 0 AS is_active,
    CASE WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 5000000 THEN 5
         WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 1000000 THEN 4
         WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 100000 THEN 3
         WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 10000 THEN 2 ELSE 1 END AS priority,
    c_custkey % 2 = 0 AS include_comments,
    TIMESTAMP '2001-01-01 00:00:00' + to_hours(CAST(c_custkey % 200 AS INTEGER)) AS created_at
  FROM customer),
control AS (
  SELECT channel_id, channel_name, crawl_frequency_hours, crawl_status, last_crawl_ts,
    coalesce(last_crawl_ts + to_hours(crawl_frequency_hours), {ASOF_TS} - INTERVAL 1 HOUR) AS next_crawl_ts,
    CAST(NULL AS TIMESTAMP) AS last_video_published_at, is_active, priority, include_comments, created_at,
    {ASOF_TS} AS updated_at
  FROM ctl)"""

RUNLOG_SQL = """
runlog AS (
  SELECT event_id AS log_id, user_id AS channel_id, ts AS crawl_ts, CAST(floor(value) AS INTEGER) AS records_fetched,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN event_type = 'error' THEN 'error ' || props END AS error_msg,
    value / 10 AS execution_time_seconds, strftime(ts, '%Y-%m-%d %H') AS batch_id
  FROM events)"""


def _control(spark, sf):
    return fx.control_table(spark, sf)


@register("t01_due_queue", "WITH " + CONTROL_SQL.strip() + f"""
SELECT * FROM control WHERE next_crawl_ts <= {ASOF_TS} AND crawl_status <> 'failed' AND is_active
ORDER BY priority DESC, last_crawl_ts ASC NULLS FIRST, channel_id LIMIT 10""")
def q_t01(spark, sf):
    """T01 due queue: due, not failed, active; priority desc, last run asc nulls first; limit 10."""
    return C.due_queue(_control(spark, sf), fx.AS_OF, 10)


@register("t02_never_run_queue", "WITH " + CONTROL_SQL.strip() + """
SELECT * FROM control WHERE last_crawl_ts IS NULL AND is_active""")
def q_t02(spark, sf):
    """T02 never-run queue (ordered priority desc, created asc)."""
    return C.never_run_queue(_control(spark, sf))


@register("t04_run_history", "WITH " + RUNLOG_SQL.strip() + """
SELECT * FROM runlog ORDER BY crawl_ts DESC, log_id DESC LIMIT 10""", ["execution_time_seconds"])
def q_t04(spark, sf):
    """T04 latest 10 run-log rows."""
    return C.history(fx.run_log(spark, sf), 10)


@register("t06_top_items_by_views", with_ctes("fact") + """
SELECT * FROM fact ORDER BY view_count DESC, video_id LIMIT 10""",
          ["like_rate_pct", "comment_rate_pct", "engagement_score", "avg_views_per_day"])
def q_t06(spark, sf):
    """T06 top 10 items by views (TakeOrderedAndProject)."""
    return T.top_k(base(spark, sf)["fact"], [F.desc("view_count"), F.asc("video_id")], 10)


@register("t09_high_water_marks", with_ctes("items") + """
SELECT channel_id, max(published_at) AS last_video_published_at FROM items GROUP BY channel_id""")
def q_t09(spark, sf):
    """T09 high-water mark: latest published item per owner."""
    return C.high_water_marks(fx.items(spark, sf))


@register("t10_recent_engaging", with_ctes("fact") + f"""
SELECT * FROM fact WHERE published_date >= {fx.AS_OF!r}::DATE - 30 AND engagement_score IS NOT NULL
ORDER BY engagement_score DESC, video_id LIMIT 10""",
          ["like_rate_pct", "comment_rate_pct", "engagement_score", "avg_views_per_day"])
def q_t10(spark, sf):
    """P17 + T10: most engaging items of the last 30 days, limit 10."""
    f = base(spark, sf)["fact"]
    recent = f.where((F.col("published_date") >= F.date_sub(F.lit(fx.AS_OF).cast("date"), 30))
                     & F.col("engagement_score").isNotNull())
    return T.top_k(recent, [F.desc("engagement_score"), F.asc("video_id")], 10)


@register("t11_recent_k_per_owner", with_ctes("items") + """
SELECT video_id, channel_id, published_at, view_count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id DESC) AS rank FROM items)
WHERE rank <= 5""")
def q_t11(spark, sf):
    """T11 latest 5 items per owner (two-round skew-safe top-k)."""
    it = fx.items(spark, sf).select("video_id", "channel_id", "published_at", "view_count")
    return T.top_k_per_group(it, ["channel_id"], [F.desc("published_at"), F.desc("video_id")], 5)


_RESULTS_SQL = """
res AS (SELECT user_id AS channel_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        WHERE rn = 1)"""


@register("i03_apply_run_results", "WITH " + CONTROL_SQL.strip() + "," + _RESULTS_SQL + f"""
SELECT c.channel_id, c.channel_name, c.crawl_frequency_hours,
  CASE WHEN r.status IN ('success', 'failed') THEN r.status ELSE c.crawl_status END AS crawl_status,
  CASE WHEN r.status = 'success' THEN {ASOF_TS} ELSE c.last_crawl_ts END AS last_crawl_ts,
  CASE WHEN r.status = 'success' THEN {ASOF_TS} + to_hours(c.crawl_frequency_hours)
       WHEN r.status = 'failed' THEN {ASOF_TS} + INTERVAL 1 HOUR ELSE c.next_crawl_ts END AS next_crawl_ts,
  c.last_video_published_at, c.is_active, c.priority, c.include_comments, c.created_at,
  CASE WHEN r.status IN ('success', 'failed') THEN {ASOF_TS} ELSE c.updated_at END AS updated_at
FROM control c LEFT JOIN res r ON c.channel_id = r.channel_id""")
def q_i03(spark, sf):
    """I03 control-table state update from the latest run result per owner."""
    runs = fx.run_log(spark, sf).select("channel_id", "status", F.struct("crawl_ts", "log_id").alias("run_ts"))
    return C.apply_run_results(_control(spark, sf), runs, fx.AS_OF)


@register("i05_incremental_slice", with_ctes("items") + """,
marks AS (SELECT channel_id, max(published_at) AS mark FROM items
          WHERE published_at < TIMESTAMP '1999-01-01' GROUP BY channel_id)
SELECT i.* FROM items i LEFT JOIN marks m ON i.channel_id = m.channel_id
WHERE m.mark IS NULL OR i.published_at > m.mark""")
def q_i05(spark, sf):
    """I05 high-water-mark incremental read against marks taken from items before 1999."""
    it = fx.items(spark, sf)
    marks = C.high_water_marks(it.where(F.col("published_at") < F.lit("1999-01-01").cast("timestamp")))
    return C.incremental_slice(it, marks)


@register("i06_crawl_mode", "WITH " + CONTROL_SQL.strip() + f"""
SELECT channel_id, (epoch_us({ASOF_TS}) - epoch_us(last_crawl_ts)) / 86400e6 AS days_since_crawl,
  CASE WHEN last_crawl_ts IS NULL OR (epoch_us({ASOF_TS}) - epoch_us(last_crawl_ts)) / 86400e6 >= 7
       THEN 'full' ELSE 'incremental' END AS crawl_mode
FROM control""", ["days_since_crawl"])
def q_i06(spark, sf):
    """I06 full-vs-incremental decision per owner."""
    return C.crawl_mode(_control(spark, sf), fx.AS_OF)


@register("i09_quota_estimate", "WITH " + CONTROL_SQL.strip() + """
SELECT count(*) AS n_channels, CAST(sum(5 + CASE WHEN include_comments THEN 10 ELSE 0 END) AS BIGINT) AS estimated_cost,
  10000 AS remaining, sum(5 + CASE WHEN include_comments THEN 10 ELSE 0 END) <= 10000 AS fits,
  CAST(greatest(sum(5 + CASE WHEN include_comments THEN 10 ELSE 0 END) - 10000, 0) AS BIGINT) AS deficit
FROM control WHERE is_active""")
def q_i09(spark, sf):
    """I09 quota cost estimate for all active owners vs the daily limit."""
    return C.quota_estimate(_control(spark, sf)).withColumn("estimated_cost", F.col("estimated_cost").cast("bigint")) \
        .withColumn("deficit", F.col("deficit").cast("bigint"))


@register("i10_quota_gate", "WITH " + CONTROL_SQL.strip() + f""",
plan AS (SELECT channel_id, priority, last_crawl_ts, 5 + CASE WHEN include_comments THEN 10 ELSE 0 END AS cost
         FROM control WHERE is_active AND next_crawl_ts <= {ASOF_TS} AND crawl_status <> 'failed')
SELECT * EXCLUDE (cum), CAST(cum AS BIGINT) AS cumulative_cost, cum - cost >= 8000 AS warn, cum - cost >= 9000 AS stop
FROM (SELECT *, sum(cost) OVER (ORDER BY priority DESC, last_crawl_ts ASC NULLS FIRST, channel_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM plan)""")
def q_i10(spark, sf):
    """I10 quota gate: running cost over the due work in queue order, warn at 80 %, stop at 90 %."""
    ctl = _control(spark, sf)
    plan = ctl.where(F.col("is_active") & (F.col("next_crawl_ts") <= F.lit(fx.AS_OF).cast("timestamp"))
                     & (F.col("crawl_status") != "failed")).select(
        "channel_id", "priority", "last_crawl_ts",
        (F.lit(5) + F.when(F.col("include_comments"), F.lit(10)).otherwise(F.lit(0))).alias("cost"))
    order = [F.desc("priority"), F.asc_nulls_first("last_crawl_ts"), F.asc("channel_id")]
    return C.quota_gate(plan, order)


@register("i12_usage_from_history", "WITH " + RUNLOG_SQL.strip() + """
SELECT count(*) AS runs, count(*) * 75 AS estimated_quota_used, 10000 AS daily_limit,
  count(*) * 75 / 10000 * 100 AS percentage_used,
  CASE WHEN count(*) * 75 / 10000 * 100 > 80 THEN 'warning' ELSE 'ok' END AS status
FROM (SELECT * FROM runlog ORDER BY crawl_ts DESC, log_id DESC LIMIT 100)""", ["percentage_used"])
def q_i12(spark, sf):
    """I12 usage estimate from the latest 100 runs x 75 units."""
    return C.usage_from_history(fx.run_log(spark, sf))


@register("a24_batch_quality", "WITH " + RUNLOG_SQL.strip() + """
SELECT *, succeeded / total * 100 AS success_rate, succeeded / total * 100 >= 50 AS passes_rate_rule,
  succeeded > 0 AS passes_nonzero_rule FROM (
  SELECT batch_id, count(*) AS total, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded,
    CAST(sum(CASE WHEN status = 'success' THEN 0 ELSE 1 END) AS BIGINT) AS failed,
    CAST(sum(CASE WHEN status = 'success' AND coalesce(records_fetched, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT)
      AS success_with_zero_records,
    CAST(sum(coalesce(records_fetched, 0)) AS BIGINT) AS records
  FROM runlog GROUP BY batch_id)""", ["success_rate"])
def q_a24(spark, sf):
    """A24 / A30 per-batch crawl quality rules."""
    return C.batch_quality(fx.run_log(spark, sf))


@register("a25_failure_alerts", "WITH " + RUNLOG_SQL.strip() + """
SELECT * FROM (SELECT batch_id, avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) AS failure_rate,
  CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS INTEGER) AS n_failed, count(*) AS n_runs
  FROM runlog GROUP BY batch_id) WHERE failure_rate > 0.5""", ["failure_rate"])
def q_a25(spark, sf):
    """A25 batches with a failure rate over 50 %."""
    return C.failure_alerts(fx.run_log(spark, sf)).withColumn("n_failed", F.col("n_failed").cast("int"))


@register("a25_failed_runs", "WITH " + RUNLOG_SQL.strip() + """,
bad AS (SELECT batch_id FROM runlog GROUP BY batch_id HAVING avg(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) > 0.5)
SELECT batch_id, channel_id, crawl_ts, error_msg FROM runlog WHERE status = 'failed' AND batch_id IN (SELECT batch_id FROM bad)""")
def q_a25_failed(spark, sf):
    """A25 the failed entities of alerting batches, one row each."""
    log = fx.run_log(spark, sf)
    return C.failed_runs(log, C.failure_alerts(log))


@register("a26_quota_rollup", """
WITH usage AS (SELECT CAST(ts AS DATE) AS date, 5 + CASE WHEN event_type = 'view' THEN 10 ELSE 0 END AS quota_used
               FROM events)
SELECT date, CAST(sum(quota_used) AS BIGINT) AS quota_used, 10000 AS daily_limit,
  sum(quota_used) / 10000 * 100 AS percentage_used,
  CASE WHEN sum(quota_used) / 10000 * 100 >= 90 THEN 'CRITICAL' WHEN sum(quota_used) / 10000 * 100 >= 80 THEN 'WARNING'
       WHEN sum(quota_used) / 10000 * 100 >= 50 THEN 'MODERATE' ELSE 'OK' END AS status
FROM usage GROUP BY date""", ["percentage_used"])
def q_a26(spark, sf):
    """I02 additive per-day usage + A26 roll-up with % used and status band."""
    ev = fx.table(spark, sf, "events")
    usage = ev.select(F.to_date("ts").alias("date"),
                      (F.lit(5) + F.when(F.col("event_type") == "view", 10).otherwise(0)).alias("quota_used"))
    return C.quota_rollup(usage).withColumn("quota_used", F.col("quota_used").cast("bigint"))


# ------------------------------------------------------------------------------------------------
# labels (C04/C05) and label quality
# ------------------------------------------------------------------------------------------------

_GRID = ", ".join(f"{t:.1f}" for t in L.threshold_grid(3.0))

LABEL_SQL = f"""
lab_in AS (
  SELECT e.*, e.view_count / greatest(coalesce(s.avg_views_per_video, 1.0), 1.0) AS view_ratio,
    coalesce(e.avg_views_per_day / (greatest(coalesce(CAST(e.channel_subscribers AS DOUBLE), 1.0), 1.0) * 0.01), 0.0)
      AS velocity_score
  FROM engagement e LEFT JOIN summary s ON e.channel_id = s.channel_id
  WHERE e.days_since_published >= 7),
grid AS (SELECT CAST(unnest([{_GRID}]) AS DOUBLE) AS t),
rates AS (SELECT g.t, avg(CASE WHEN view_ratio >= g.t THEN 1.0 ELSE 0.0 END) * 100 AS r_ratio,
                 avg(CASE WHEN view_ratio >= g.t OR velocity_score >= 1.0 THEN 1.0 ELSE 0.0 END) * 100 AS r_comb
          FROM lab_in CROSS JOIN grid g GROUP BY g.t),
st AS (SELECT CASE WHEN avg(CASE WHEN is_potentially_viral THEN 1.0 ELSE 0.0 END) * 100 BETWEEN 8 AND 20
                   THEN 'existing' ELSE 'combined' END AS strat FROM lab_in),
w0 AS (SELECT strat, CAST(3.0 AS DOUBLE) AS t FROM st),
""" + ",\n".join(
    f"""w{i + 1} AS (SELECT w.strat, CASE WHEN w.strat = 'existing' THEN w.t
                 WHEN (CASE WHEN w.strat = 'ratio' THEN r.r_ratio ELSE r.r_comb END) < 5 THEN round(w.t - 0.5, 1)
                 WHEN (CASE WHEN w.strat = 'ratio' THEN r.r_ratio ELSE r.r_comb END) > 30 THEN round(w.t + 0.5, 1)
                 ELSE w.t END AS t
          FROM w{i} w LEFT JOIN rates r ON r.t = w.t)""" for i in range(5)) + """,
labeled AS (
  SELECT l.video_id, l.channel_id, l.view_count, l.days_since_published, l.view_ratio, l.velocity_score,
    CAST(CASE WHEN w.strat = 'existing' THEN l.is_potentially_viral
              WHEN w.strat = 'ratio' THEN l.view_ratio >= w.t
              ELSE l.view_ratio >= w.t OR l.velocity_score >= 1.0 END AS INTEGER) AS is_viral,
    w.strat AS label_strategy, w.t AS view_ratio_threshold
  FROM lab_in l CROSS JOIN w5 w)"""


def _labeled(spark, sf):
    b = base(spark, sf)
    return b, L.viral_label(b["engagement"], b["channel_summary"], strategy="auto")


@register("c04_viral_label", with_ctes("engagement", "summary", extra=LABEL_SQL) + "SELECT * FROM labeled",
          ["view_ratio", "velocity_score", "view_ratio_threshold"])
def q_c04(spark, sf):
    """C04 + C05 viral label, auto strategy, threshold walk from one grid aggregate."""
    return _labeled(spark, sf)[1]


@register("a05_group_rate_summary", with_ctes("engagement", "summary", extra=LABEL_SQL) + """,
prof AS (SELECT channel_id, sum(is_viral) AS viral_videos, count(*) AS total_videos,
                sum(is_viral) / count(*) * 100 AS viral_rate FROM labeled GROUP BY channel_id)
SELECT count(*) AS n_groups, CAST(sum(CASE WHEN viral_rate = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_rate_groups,
       CAST(sum(CASE WHEN viral_rate = 100 THEN 1 ELSE 0 END) AS BIGINT) AS full_rate_groups FROM prof""")
def q_a05(spark, sf):
    """A05 number of owners at 0 % and 100 % positive rate."""
    return L.group_rate_summary(L.group_rate_profile(_labeled(spark, sf)[1])) \
        .withColumn("zero_rate_groups", F.col("zero_rate_groups").cast("bigint")) \
        .withColumn("full_rate_groups", F.col("full_rate_groups").cast("bigint"))


@register("t05_top_bottom_groups", with_ctes("engagement", "summary", extra=LABEL_SQL) + """,
prof AS (SELECT channel_id, CAST(sum(is_viral) AS BIGINT) AS viral_videos, count(*) AS total_videos,
                sum(is_viral) / count(*) * 100 AS viral_rate FROM labeled GROUP BY channel_id)
(SELECT *, 'top' AS side FROM prof ORDER BY viral_rate DESC, channel_id LIMIT 5)
UNION ALL
(SELECT *, 'bottom' AS side FROM prof ORDER BY viral_rate ASC, channel_id LIMIT 5)""", ["viral_rate"])
def q_t05(spark, sf):
    """T05 top and bottom 5 owners by positive rate."""
    return L.top_bottom_groups(L.group_rate_profile(_labeled(spark, sf)[1]))


@register("a06_monthly_rate_profile", with_ctes("engagement", "summary", extra=LABEL_SQL) + """,
m AS (SELECT strftime(e.published_at, '%Y-%m') AS year_month, avg(l.is_viral) * 100 AS viral_rate_pct,
             count(*) AS n_videos
      FROM labeled l LEFT JOIN enhanced e ON l.video_id = e.video_id GROUP BY 1),
o AS (SELECT avg(is_viral) * 100 AS overall_rate_pct FROM labeled)
SELECT m.*, o.overall_rate_pct, abs(m.viral_rate_pct - o.overall_rate_pct) > 15 AS drift_flag
FROM m CROSS JOIN o""", ["viral_rate_pct", "overall_rate_pct"])
def q_a06(spark, sf):
    """A06 monthly positive rate with a ±15-point drift flag."""
    b, lab = _labeled(spark, sf)
    return L.monthly_rate_profile(lab, b["enhanced"])


@register("a07_category_rate_profile", with_ctes("engagement", "summary", extra=LABEL_SQL) + """,
c AS (SELECT e.video_length_category, avg(l.is_viral) * 100 AS viral_rate_pct, count(*) AS n_videos
      FROM labeled l LEFT JOIN enhanced e ON l.video_id = e.video_id GROUP BY 1),
o AS (SELECT avg(viral_rate_pct) AS others FROM c WHERE video_length_category <> 'shorts')
SELECT c.*, CASE WHEN c.video_length_category = 'shorts' THEN abs(c.viral_rate_pct - o.others) END AS focus_gap,
  coalesce(CASE WHEN c.video_length_category = 'shorts' THEN abs(c.viral_rate_pct - o.others) END > 10, false)
    AS gap_flag
FROM c CROSS JOIN o""", ["viral_rate_pct", "focus_gap"])
def q_a07(spark, sf):
    """A07 positive rate per length class and the shorts-vs-others gap."""
    b, lab = _labeled(spark, sf)
    return L.category_rate_profile(lab, b["enhanced"])


@register("a08_leak_correlations", with_ctes("engagement", "summary", extra=LABEL_SQL) + """,
j AS (SELECT l.is_viral, e.is_potentially_viral, e.engagement_level FROM labeled l
      LEFT JOIN engagement e ON l.video_id = e.video_id),
r AS (SELECT corr(CAST(is_viral AS DOUBLE), CAST(CAST(is_potentially_viral AS INTEGER) AS DOUBLE)) AS a,
             corr(CAST(is_viral AS DOUBLE), CAST(CASE coalesce(engagement_level, 'low') WHEN 'high' THEN 2
                  WHEN 'medium' THEN 1 ELSE 0 END AS DOUBLE)) AS b FROM j)
SELECT 'is_potentially_viral' AS feature, a AS corr, coalesce(abs(a) > 0.7, false) AS leak_flag FROM r
UNION ALL SELECT 'engagement_level', b, coalesce(abs(b) > 0.7, false) FROM r""", ["corr"])
def q_a08(spark, sf):
    """A08 Pearson correlation of the label with candidate leak columns."""
    b, lab = _labeled(spark, sf)
    return L.leak_correlations(lab, b["engagement"])


@register("a13_label_stats", with_ctes("engagement", "summary", extra=LABEL_SQL) + """
SELECT count(*) AS total_videos, CAST(sum(is_viral) AS BIGINT) AS viral_count,
  round(sum(is_viral) / count(*) * 100, 2) AS viral_rate, max(label_strategy) AS strategy,
  round(coalesce(min(CASE WHEN is_viral = 1 THEN view_ratio END), 0.0), 2) AS threshold,
  min(days_since_published) AS min_days
FROM labeled""", ["viral_rate", "threshold"])
def q_a13(spark, sf):
    """A13 label statistics row."""
    return L.label_stats(_labeled(spark, sf)[1])


@register("c06_label_quality_report", with_ctes("engagement", "summary", extra=LABEL_SQL) + """,
prof AS (SELECT channel_id, sum(is_viral) / count(*) * 100 AS r FROM labeled GROUP BY channel_id),
ov AS (SELECT avg(is_viral) * 100 AS v FROM labeled),
mo AS (SELECT strftime(e.published_at, '%Y-%m') AS ym, avg(l.is_viral) * 100 AS r FROM labeled l
       LEFT JOIN enhanced e ON l.video_id = e.video_id GROUP BY 1),
lk AS (SELECT corr(CAST(l.is_viral AS DOUBLE), CAST(CAST(m.is_potentially_viral AS INTEGER) AS DOUBLE)) AS a,
              corr(CAST(l.is_viral AS DOUBLE), CAST(CASE coalesce(m.engagement_level, 'low') WHEN 'high' THEN 2
                   WHEN 'medium' THEN 1 ELSE 0 END AS DOUBLE)) AS b
       FROM labeled l LEFT JOIN engagement m ON l.video_id = m.video_id)
SELECT 'overall_rate' AS check_name, v AS value, CASE WHEN v BETWEEN 5 AND 30 THEN 'PASS' ELSE 'WARN' END AS status FROM ov
UNION ALL SELECT 'owners_at_100pct', CAST(sum(CASE WHEN r = 100 THEN 1 ELSE 0 END) AS DOUBLE),
  CASE WHEN sum(CASE WHEN r = 100 THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'WARN' END FROM prof
UNION ALL SELECT 'owners_at_0pct', CAST(sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) AS DOUBLE),
  CASE WHEN sum(CASE WHEN r = 0 THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'WARN' END FROM prof
UNION ALL SELECT 'seasonal_drift_months', CAST(sum(CASE WHEN abs(mo.r - ov.v) > 15 THEN 1 ELSE 0 END) AS DOUBLE),
  CASE WHEN sum(CASE WHEN abs(mo.r - ov.v) > 15 THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'WARN' END FROM mo CROSS JOIN ov
UNION ALL SELECT 'leakage_columns', CAST(CAST(coalesce(abs(a) > 0.7, false) AS INTEGER) + CAST(coalesce(abs(b) > 0.7, false) AS INTEGER)
  AS DOUBLE), CASE WHEN coalesce(abs(a) > 0.7, false) OR coalesce(abs(b) > 0.7, false) THEN 'WARN' ELSE 'PASS' END FROM lk""",
          ["value"])
def q_c06(spark, sf):
    """C06 label quality report as check rows (overall rate, biased owners, seasonal drift, leakage)."""
    b, lab = _labeled(spark, sf)
    return L.label_quality_report(lab, b["enhanced"], b["engagement"])


@register("q08_optional_consistency_checks", with_ctes("daily", "fact", extra=_DIFF_A + "," + _RECON) + """
SELECT 'consistency_version_diff' AS check_name, 'error' AS severity,
  (SELECT count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)))
    AS failures, 'fail' AS status
UNION ALL SELECT 'integrity_reconcile', 'error', (SELECT count(*) FROM rj WHERE
  a_total_views IS DISTINCT FROM b_total_views OR a_total_likes IS DISTINCT FROM b_total_likes
  OR a_total_comments IS DISTINCT FROM b_total_comments OR a_n_items IS DISTINCT FROM b_n_items), 'fail'""")
def q_q08(spark, sf):
    """Q08 version-diff (U01) and reconciliation (J09) as suite checks, enabled by a flag (on here)."""
    from ..operators import quality as Q
    a, b = _diff_frames(spark, sf)
    ra, rb = _recon_frames(spark, sf)
    enabled = True
    return Q.run_suite([Q.Check("consistency_version_diff", T.symmetric_diff(a, b), enabled=enabled),
                        Q.Check("integrity_reconcile", T.reconcile(ra, rb, ["channel_id", "category_id"], _MEASURES),
                                enabled=enabled)])
