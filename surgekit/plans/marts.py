"""Intermediate and mart relations.

All functions are lazy ``DataFrame -> DataFrame`` compositions. ``as_of`` replaces the wall clock
so results are reproducible.

Scale notes
* C01 joins items to owners on the owner key. Owners is a per-entity table; the join is left to
  AQE (runtime broadcast when the measured side is small, otherwise sort-merge with skew-split of a
  hot owner partition on the streamed side).
* C02 and C03 are projections on C01: the fact table does not re-join the metrics view to the view
  it was computed from (one scan, no self-join).
* A01/A03 aggregate above the owner join. Alone, Spark would reuse the join's partitioning and leave a hot owner in one
  task; ``session.configure`` forces the skew split of the join, after which the aggregate gets an exchange of its own and
  pre-combines the hot owner's rows in the split tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


def enhanced(items: DataFrame, owners: DataFrame, as_of: str) -> DataFrame:
    """Items ⟕ owners + duration seconds + date parts + age + length class."""
    o = owners.select(
        F.col("channel_id").alias("_cid"), "channel_name",
        F.col("subscriber_count").alias("channel_subscribers"), "country_code", "channel_created_at")
    v = items.join(o, items["channel_id"] == o["_cid"], "left").drop("_cid")
    # duration seconds come out of a one-element explode: a filter on a column derived from it (length
    # class, quality checks) then stays above the regex parse instead of inlining it per comparison;
    # filters on the other columns still push down to the scan
    v = v.select("*", F.explode(F.array(X.iso_duration_lenient("duration_iso8601"))).alias("duration_seconds"))
    parts = X.date_parts("published_at")
    return v.select(
        "video_id", "channel_id", "title", "description", "tags", "category_id", "default_language",
        "published_at", "view_count", "like_count", "comment_count", "duration_iso8601", "has_caption",
        "definition", "privacy_status", "is_embeddable", "is_made_for_kids", "crawled_at",
        "channel_name", "channel_subscribers", "country_code", "channel_created_at", "duration_seconds",
        *[c.alias(n) for n, c in parts.items()],
        X.days_between(as_of, "published_at").alias("days_since_published"),
        X.length_class("duration_seconds").alias("video_length_category"),
    )


def _metric_columns() -> dict[str, F.Column]:
    v, lk, cm = F.col("view_count"), F.col("like_count"), F.col("comment_count")
    d = F.col("days_since_published")
    pos = v > 0
    vpd = X.safe_div(v, X.nullif(d, 0))
    return {
        "like_rate_pct": F.when(pos, F.least(lk / v * 100, F.lit(100.0))).otherwise(F.lit(0.0)),
        "comment_rate_pct": F.when(pos, F.least(cm / v * 100, F.lit(100.0))).otherwise(F.lit(0.0)),
        "engagement_score": F.when(pos, (lk + cm * 2) / v * 100).otherwise(F.lit(0.0)),
        "avg_views_per_day": vpd,
        "engagement_level": X.engagement_level(lk, v),
        "is_potentially_viral": F.coalesce(vpd > F.col("channel_subscribers") * 0.1, F.lit(False)),
    }


ENGAGEMENT_COLUMNS = ["video_id", "channel_id", "title", "published_at", "published_date", "view_count",
                      "like_count", "comment_count", "days_since_published", "video_length_category",
                      "channel_name", "channel_subscribers", "country_code"]


def engagement(enh: DataFrame) -> DataFrame:
    """C02 (+ P10 age filter): engagement metrics for items of age >= 1 day."""
    m = _metric_columns()
    return enh.where(F.col("days_since_published") > 0).select(
        *ENGAGEMENT_COLUMNS, *[c.alias(n) for n, c in m.items()])


def fact(enh: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Fact table = C01 ⟕ C02; metrics are NULL for items of age 0 (computed as a projection
    of C01, which is what the key join on the same items produces); ``extra`` columns of C01 follow."""
    m = _metric_columns()
    aged = F.col("days_since_published") > 0
    mcols = [F.when(aged, m[n]).alias(n) for n in
             ("like_rate_pct", "comment_rate_pct", "engagement_score", "avg_views_per_day", "engagement_level",
              "is_potentially_viral")]
    return enh.select(
        "video_id", "channel_id", "category_id", "title", "published_at", "published_date", "published_year",
        "published_month", "channel_name", "country_code", "video_length_category", "duration_seconds",
        "view_count", "like_count", "comment_count", *mcols,
        "has_caption", "is_embeddable", "is_made_for_kids", "definition", "crawled_at", *extra)


def channel_summary(enh: DataFrame) -> DataFrame:
    """Per-owner summary. any_value columns are functionally dependent on the key."""
    v, lk, cm = F.col("view_count"), F.col("like_count"), F.col("comment_count")
    nvid = F.count_distinct("video_id")
    latest, earliest = F.to_date(F.max("published_at")), F.to_date(F.min("published_at"))
    return enh.groupBy("channel_id").agg(
        F.any_value("channel_name").alias("channel_name"),
        F.any_value("country_code").alias("country_code"),
        F.any_value("channel_subscribers").alias("subscriber_count"),
        F.any_value("channel_created_at").alias("channel_created_at"),
        nvid.alias("total_videos_crawled"),
        F.sum(v).alias("total_views"),
        F.avg(v).alias("avg_views_per_video"),
        F.sum(lk).alias("total_likes"),
        F.sum(cm).alias("total_comments"),
        (F.avg(X.safe_div(lk, X.nullif(v, 0))) * 100).alias("avg_like_rate_pct"),
        (F.avg(X.safe_div(cm, X.nullif(v, 0))) * 100).alias("avg_comment_rate_pct"),
        F.avg("duration_seconds").alias("avg_video_duration_seconds"),
        latest.alias("latest_video_date"),
        earliest.alias("earliest_video_date"),
        X.safe_div(F.datediff(latest, earliest), X.nullif(nvid - 1, 0)).alias("avg_days_between_uploads"),
        F.max("crawled_at").alias("last_crawled_at"),
    )


def dim_channel(summary: DataFrame) -> DataFrame:
    """Post-aggregation ratios over A01."""
    span = F.datediff("latest_video_date", "earliest_video_date")
    return summary.select(
        "channel_id", "channel_name", "country_code", "subscriber_count", "channel_created_at",
        "total_videos_crawled", "total_views", "avg_views_per_video", "total_likes", "total_comments",
        "avg_like_rate_pct", "avg_comment_rate_pct", "avg_video_duration_seconds",
        "latest_video_date", "earliest_video_date", span.alias("channel_active_days"),
        "avg_days_between_uploads",
        X.safe_div("total_views", "subscriber_count").alias("views_per_subscriber"),
        (X.safe_div("total_videos_crawled", X.nullif(span, 0)) * 7).alias("videos_per_week"),
        "last_crawled_at")


def daily_rollup(fct: DataFrame) -> DataFrame:
    """(publish date, owner) rollup over items ⟕ engagement with a surrogate key; engagement
    averages skip age-0 rows."""
    g = fct.groupBy(F.to_date("published_at").alias("metric_date"), "channel_id").agg(
        F.any_value("channel_name").alias("channel_name"),
        F.any_value("country_code").alias("country_code"),
        F.count_distinct("video_id").alias("videos_published"),
        F.sum("view_count").alias("total_views"),
        F.sum("like_count").alias("total_likes"),
        F.sum("comment_count").alias("total_comments"),
        F.avg("engagement_score").alias("avg_engagement_score"),
        F.avg("like_rate_pct").alias("avg_like_rate_pct"),
        F.max("view_count").alias("max_video_views"))
    return g.select(X.surrogate_key("metric_date", "channel_id").alias("date_channel_key"), "*")


def build_marts(items: DataFrame, owners: DataFrame, as_of: str) -> dict[str, DataFrame]:
    enh = enhanced(items, owners, as_of)
    fct = fact(enh)
    summ = channel_summary(enh)
    return {"enhanced": enh, "engagement": engagement(enh), "fact": fct, "channel_summary": summ,
            "dim_channel": dim_channel(summ), "daily": daily_rollup(fct)}
