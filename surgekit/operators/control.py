"""Control tables and incremental state.

The reference keeps these in a row store and updates them one statement at a time; here every update is
a set-based join of a run-results table onto the control table, producing the next version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

# fixed values of the control tables
DEFAULT_FREQUENCY_HOURS = 24
DEFAULT_STATUS = "pending"
DEFAULT_PRIORITY = 1
DAILY_QUOTA = 10_000
FAILED_RETRY_HOURS = 1
FULL_CRAWL_AFTER_DAYS = 7
QUOTA_WARN, QUOTA_STOP = 0.8, 0.9
COST_BASE, COST_VIDEOS, COST_COMMENTS = 3, 2, 10
HISTORY_COST_PER_RUN = 75
FAILURE_ALERT_RATE = 0.5

CONTROL_COLUMNS = ["channel_id", "channel_name", "crawl_frequency_hours", "crawl_status", "last_crawl_ts",
                   "next_crawl_ts", "last_video_published_at", "is_active", "priority", "include_comments",
                   "created_at", "updated_at"]


def _ts(s) -> Column:
    return F.lit(s).cast("timestamp") if isinstance(s, str) else s


def _hours(n) -> Column:
    return F.make_dt_interval(hours=n if isinstance(n, Column) else F.lit(n))


def due_queue(control: DataFrame, as_of, limit: int = 10) -> DataFrame:
    """Due, not failed, active; priority desc, last run asc NULLS FIRST, key; limit."""
    return (control.where((F.col("next_crawl_ts") <= _ts(as_of)) & (F.col("crawl_status") != "failed")
                          & F.col("is_active"))
            .orderBy(F.desc("priority"), F.asc_nulls_first("last_crawl_ts"), F.asc("channel_id"))
            .limit(limit))


def never_run_queue(control: DataFrame, limit: int | None = None) -> DataFrame:
    """Never run and active; priority desc, created asc, key."""
    d = (control.where(F.col("last_crawl_ts").isNull() & F.col("is_active"))
         .orderBy(F.desc("priority"), F.asc("created_at"), F.asc("channel_id")))
    return d.limit(limit) if limit else d


def listing(control: DataFrame) -> DataFrame:
    """Priority desc, next run, key."""
    return control.orderBy(F.desc("priority"), F.asc("next_crawl_ts"), F.asc("channel_id"))


def history(log: DataFrame, limit: int = 10, key=None) -> DataFrame:
    """Latest ``limit`` run-log rows, optionally for one key."""
    d = log if key is None else log.where(F.col("channel_id") == F.lit(key))
    return d.orderBy(F.desc("crawl_ts"), F.desc("log_id")).limit(limit)


def apply_run_results(control: DataFrame, results: DataFrame, as_of) -> DataFrame:
    """Success -> last = now, next = now + frequency, status success;
    failure -> status failed, next = now + 1 h. ``results`` has (channel_id, status); one row per key
    is taken (the last by run_ts when present)."""
    now = _ts(as_of)
    r = results
    if "run_ts" in r.columns:
        from .tables import keep_latest
        r = keep_latest(r.select("channel_id", "status", "run_ts"), ["channel_id"], ["run_ts"])
    r = r.select("channel_id", F.col("status").alias("_st"))
    j = control.join(r, "channel_id", "left")
    ok = F.col("_st") == "success"
    bad = F.col("_st") == "failed"
    return j.select(
        *[(F.when(ok, now).otherwise(F.col(c)).alias(c) if c == "last_crawl_ts" else
           F.when(ok, now + _hours(F.col("crawl_frequency_hours"))).when(bad, now + _hours(FAILED_RETRY_HOURS))
            .otherwise(F.col(c)).alias(c) if c == "next_crawl_ts" else
           F.when(ok | bad, F.col("_st")).otherwise(F.col(c)).alias(c) if c == "crawl_status" else
           F.when(ok | bad, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c))
          for c in control.columns])


def append_run_log(log: DataFrame, results: DataFrame, as_of=None) -> DataFrame:
    """The log with one row more for every run of ``results`` (channel_id, status, and what it has of the log's other columns).
    New ids follow the log's greatest in the order of run time, channel and the rest of the row (distributed rank; an empty log starts
    at 1). A successful run has no error text, a failed one neither records nor a run time; runs of any other status are not
    logged. ``as_of`` stamps runs that bring no ``crawl_ts``. Equal runs are all logged."""
    from .ordering import global_rank
    from .tables import attach_scalars
    ok, bad = F.col("status") == "success", F.col("status") == "failed"
    only = {"records_fetched": ok, "execution_time_seconds": ok, "error_msg": bad}
    stamp = F.lit(None) if as_of is None else _ts(as_of)
    given = {c: F.col(c) if c in results.columns else F.lit(None) for c in log.columns if c != "log_id"}
    given["crawl_ts"] = F.coalesce(given["crawl_ts"], stamp)
    runs = results.where(ok | bad).select(*[(F.when(only[c], v) if c in only else v).cast(log.schema[c].dataType).alias(c)
                                            for c, v in given.items()])
    runs = global_rank(runs, ["crawl_ts", "channel_id", *[c for c in runs.columns if c not in ("crawl_ts", "channel_id")]], rank_col="_rk")
    top = log.agg(F.coalesce(F.max("log_id"), F.lit(0)).alias("_top"))
    runs = attach_scalars(runs, top).withColumn("log_id", (F.col("_top") + F.col("_rk")).cast(log.schema["log_id"].dataType))
    return log.unionByName(runs.select(*log.columns))


def high_water_marks(items: DataFrame, key: str = "channel_id", ts: str = "published_at") -> DataFrame:
    """Latest published item per entity."""
    return items.groupBy(key).agg(F.max(ts).alias("last_video_published_at"))


def incremental_slice(items: DataFrame, marks: DataFrame, key: str = "channel_id", ts: str = "published_at",
                      mark_col: str = "last_video_published_at") -> DataFrame:
    """Only records newer than the entity's mark; entities without a mark load fully."""
    m = marks.select(key, mark_col)
    j = items.join(m, key, "left")
    return j.where(F.col(mark_col).isNull() | (F.col(ts) > F.col(mark_col))).drop(mark_col)


def advance_marks(marks: DataFrame, new_items: DataFrame, key: str = "channel_id", ts: str = "published_at",
                  mark_col: str = "last_video_published_at") -> DataFrame:
    """mark = greatest(old mark, newest loaded record) (union + aggregate, no join)."""
    u = marks.select(key, F.col(mark_col).alias("_m")).unionByName(
        new_items.select(key, F.col(ts).alias("_m")))
    return u.groupBy(key).agg(F.max("_m").alias(mark_col))


def crawl_mode(control: DataFrame, as_of) -> DataFrame:
    """Full crawl when never run or the last run is >= 7 days old, else incremental."""
    days = (F.unix_micros(_ts(as_of)) - F.unix_micros(F.col("last_crawl_ts"))) / F.lit(86400e6)
    full = F.col("last_crawl_ts").isNull() | (days >= FULL_CRAWL_AFTER_DAYS)
    return control.select("channel_id", days.alias("days_since_crawl"),
                          F.when(full, F.lit("full")).otherwise(F.lit("incremental")).alias("crawl_mode"))


def quota_estimate(control: DataFrame, used: int = 0, limit: int = DAILY_QUOTA) -> DataFrame:
    """(3 + 2 [+ 10 with comments]) units per planned entity vs remaining quota."""
    cost = F.lit(COST_BASE + COST_VIDEOS) + F.when(F.col("include_comments"), F.lit(COST_COMMENTS)).otherwise(F.lit(0))
    agg = control.where(F.col("is_active")).agg(F.count(F.lit(1)).alias("n_channels"),
                                                F.sum(cost).alias("estimated_cost"))
    rem = F.lit(limit - used)
    return agg.select("*", rem.alias("remaining"), (F.col("estimated_cost") <= rem).alias("fits"),
                      F.greatest(F.col("estimated_cost") - rem, F.lit(0)).alias("deficit"))


def quota_gate(plan: DataFrame, order_cols, used: int = 0, limit: int = DAILY_QUOTA) -> DataFrame:
    """Running cost over the planned work in queue order; ``warn`` once 80 % is used before a row,
    ``stop`` once 90 % is. The running sum is distributed (``ordering.running_sum``); the ordering must be
    unique (end it with the key)."""
    from .ordering import running_sum
    r = running_sum(plan, order_cols, "cost", out_col="_cum")
    cum = (F.lit(used) + F.col("_cum")).cast("bigint")
    before = cum - F.col("cost")
    return r.select(*plan.columns, cum.alias("cumulative_cost"),
                    (before >= limit * QUOTA_WARN).alias("warn"), (before >= limit * QUOTA_STOP).alias("stop"))


def quota_rollup(usage: DataFrame, limit: int = DAILY_QUOTA) -> DataFrame:
    """Usage per day, % of the limit and status band (I02 additive upsert feeds it)."""
    g = usage.groupBy("date").agg(F.sum("quota_used").alias("quota_used"))
    pct = F.col("quota_used") / F.lit(limit) * 100
    edges, labels = X.QUOTA_STATUS
    return g.select("date", "quota_used", F.lit(limit).alias("daily_limit"), pct.alias("percentage_used"),
                    X.band(pct, edges, labels, descending=True).alias("status"))


def usage_from_history(log: DataFrame, limit: int = DAILY_QUOTA, runs: int = 100) -> DataFrame:
    """Latest ``runs`` log rows x 75 units vs the daily limit, warning over 80 %."""
    n = history(log, runs).agg(F.count(F.lit(1)).alias("runs"))
    est = F.col("runs") * HISTORY_COST_PER_RUN
    pct = est / F.lit(limit) * 100
    return n.select("runs", est.alias("estimated_quota_used"), F.lit(limit).alias("daily_limit"),
                    pct.alias("percentage_used"), F.when(pct > 80, F.lit("warning")).otherwise(F.lit("ok")).alias("status"))


def batch_quality(log: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Per batch totals, success rate, >= 50 % rule, zero-success rule, success-with-0 warning."""
    ok = (F.col("status") == "success").cast("int")
    g = log.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("total"), F.sum(ok).alias("succeeded"),
        F.sum(1 - ok).alias("failed"),
        F.sum(((F.col("status") == "success") & (F.coalesce(F.col("records_fetched"), F.lit(0)) == 0)).cast("int"))
         .alias("success_with_zero_records"),
        F.sum(F.coalesce(F.col("records_fetched"), F.lit(0))).alias("records"))
    rate = F.col("succeeded") / F.col("total") * 100
    return g.select("*", rate.alias("success_rate"), (rate >= 50).alias("passes_rate_rule"),
                    (F.col("succeeded") > 0).alias("passes_nonzero_rule"))


def failure_alerts(log: DataFrame, batch_col: str = "batch_id", rate: float = FAILURE_ALERT_RATE) -> DataFrame:
    """Batches whose failure rate exceeds ``rate``; the failed keys stay rows (see ``failed_runs``)
    instead of a per-batch list, so no batch is ever gathered into one value."""
    bad = F.col("status") == "failed"
    g = log.groupBy(batch_col).agg(F.avg(bad.cast("double")).alias("failure_rate"),
                                   F.sum(bad.cast("int")).alias("n_failed"), F.count(F.lit(1)).alias("n_runs"))
    return g.where(F.col("failure_rate") > rate)


def failed_runs(log: DataFrame, alerts: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """The failed keys of alerting batches, one row each."""
    return (log.where(F.col("status") == "failed").join(alerts.select(batch_col), batch_col, "left_semi")
               .select(batch_col, "channel_id", "crawl_ts", "error_msg"))
