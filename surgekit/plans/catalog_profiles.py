"""Catalog entries for profiles (A09–A12, A14, A20–A22, A27, A29), owner / item features (M14–M16),
group windows (W05, W06), owner and z-score labels (C07, C08) and the quality suite (Q01–Q12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entity_features as EF
from ..operators import labels as L
from ..operators import profiles as PR
from ..operators import quality as Q
from ..sources import fixtures as fx
from . import marts
from .catalog import base, owner_features, owner_labels, register
from .catalog_ops import CONTROL_SQL
from .oracle import with_ctes
from .relations import shared

LAB0_SQL = """
lab0 AS (
  SELECT e.*, e.view_count / greatest(coalesce(s.avg_views_per_video, 1.0), 1.0) AS view_ratio,
    coalesce(e.avg_views_per_day / (greatest(coalesce(CAST(e.channel_subscribers AS DOUBLE), 1.0), 1.0) * 0.01), 0.0)
      AS velocity_score
  FROM engagement e LEFT JOIN summary s ON e.channel_id = s.channel_id)"""


def _lab0(spark, sf):
    b = base(spark, sf)
    return L.label_inputs(b["engagement"], b["channel_summary"], min_days=0)


@register("a09_percentile_profile", with_ctes("engagement") + """
SELECT quantile_cont(view_count, 0.10) AS p10, quantile_cont(view_count, 0.25) AS p25,
  quantile_cont(view_count, 0.50) AS p50, quantile_cont(view_count, 0.75) AS p75,
  quantile_cont(view_count, 0.90) AS p90, quantile_cont(view_count, 0.95) AS p95,
  quantile_cont(view_count, 0.99) AS p99, CAST(min(view_count) AS DOUBLE) AS min,
  CAST(max(view_count) AS DOUBLE) AS max, avg(view_count) AS mean, stddev_samp(view_count) AS std
FROM engagement""", ["p10", "p25", "p50", "p75", "p90", "p95", "p99", "min", "max", "mean", "std"])
def q_a09(spark, sf):
    """A09 exact percentile profile of item views."""
    return PR.percentile_profile(base(spark, sf)["engagement"], "view_count")


@register("a10_share_above_thresholds", with_ctes("engagement", "summary", extra=LAB0_SQL) + """
SELECT avg(CASE WHEN view_ratio >= 2.0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_ratio_ge_2x,
  avg(CASE WHEN view_ratio >= 3.0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_ratio_ge_3x,
  avg(CASE WHEN view_ratio >= 5.0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_ratio_ge_5x,
  avg(CASE WHEN velocity_score IS NULL OR isnan(velocity_score) THEN NULL
           WHEN velocity_score >= 1.0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_velocity_ge_1
FROM lab0""", ["pct_ratio_ge_2x", "pct_ratio_ge_3x", "pct_ratio_ge_5x", "pct_velocity_ge_1"])
def q_a10(spark, sf):
    """A10 share of items above ratio thresholds and velocity >= 1."""
    return PR.share_above(_lab0(spark, sf))


@register("a11_strategy_recommendation", with_ctes("engagement", "summary", extra=LAB0_SQL) + """
SELECT *, CASE WHEN abs(rate_existing - 14) <= abs(rate_ratio - 14) AND abs(rate_existing - 14) <= abs(rate_combined - 14)
               THEN 'existing' WHEN abs(rate_ratio - 14) <= abs(rate_combined - 14) THEN 'ratio' ELSE 'combined' END
          AS recommended
FROM (SELECT avg(CASE WHEN coalesce(is_potentially_viral, false) THEN 1.0 ELSE 0.0 END) * 100 AS rate_existing,
             avg(CASE WHEN view_ratio >= 3.0 THEN 1.0 ELSE 0.0 END) * 100 AS rate_ratio,
             avg(CASE WHEN view_ratio >= 3.0 OR coalesce(velocity_score >= 1.0, false) THEN 1.0 ELSE 0.0 END) * 100
               AS rate_combined FROM lab0)""", ["rate_existing", "rate_ratio", "rate_combined"])
def q_a11(spark, sf):
    """A11 label strategy nearest to a 14 % positive rate."""
    return PR.strategy_recommendation(_lab0(spark, sf))


@register("a12_log_histogram", with_ctes("engagement") + """,
x AS (SELECT ln(1 + CAST(view_count AS DOUBLE)) AS x FROM engagement WHERE view_count IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 60), 59) END AS INTEGER) AS bin,
             lo, hi FROM x CROSS JOIN r)
SELECT bin, lo + bin * (hi - lo) / 60 AS bin_start, lo + (bin + 1) * (hi - lo) / 60 AS bin_end, count(*) AS n_rows
FROM b GROUP BY bin, lo, hi""", ["bin_start", "bin_end"])
def q_a12(spark, sf):
    """A12 60-bin histogram of log1p(views)."""
    return PR.log_histogram(base(spark, sf)["engagement"], "view_count")


@register("a14_load_summary", with_ctes("engagement", "summary") + """
SELECT (SELECT count(*) FROM enhanced) AS enhanced_rows, (SELECT count(*) FROM engagement) AS engagement_rows,
  (SELECT count(*) FROM summary) AS summary_rows, count(DISTINCT channel_id) AS distinct_owners,
  avg(CAST(is_potentially_viral AS DOUBLE)) * 100 AS flag_rate_pct
FROM engagement""", ["flag_rate_pct"])
def q_a14(spark, sf):
    """A14 load summary over the three intermediate relations."""
    b = base(spark, sf)
    return PR.load_summary({"enhanced": b["enhanced"], "engagement": b["engagement"], "summary": b["channel_summary"]})


# --- owner / item features -----------------------------------------------------------------------

OWNER_FEAT_SQL = """
g0 AS (SELECT channel_id, epoch_us(published_at) / 86400e6 AS t FROM enhanced WHERE published_at IS NOT NULL),
gp AS (SELECT channel_id, t - lag(t) OVER (PARTITION BY channel_id ORDER BY t) AS gap FROM g0),
cons AS (SELECT channel_id, CASE WHEN count(gap) >= 2 AND avg(gap) > 0
                 THEN 1 / (1 + sqrt(greatest(coalesce(var_samp(gap), 0.0), 0.0)) / avg(gap)) ELSE 0.0 END AS f4
         FROM gp GROUP BY channel_id),
rk AS (SELECT channel_id, CAST(view_count AS DOUBLE) AS v,
         row_number() OVER (PARTITION BY channel_id ORDER BY published_at DESC, video_id DESC) AS rn FROM enhanced),
tr AS (SELECT channel_id, sum(v) AS st, count(*) AS nt, sum(CASE WHEN rn <= 5 THEN v END) AS sr,
         count(CASE WHEN rn <= 5 THEN 1 END) AS nr FROM rk GROUP BY channel_id),
trend AS (SELECT channel_id, CASE WHEN nt - nr > 0 AND (st - sr) / (nt - nr) > 0
                   THEN (sr / nr) / ((st - sr) / (nt - nr)) ELSE 1.0 END AS f11 FROM tr),
ofeat AS (
  SELECT s.channel_id, s.subscriber_count,
    greatest(coalesce(CAST(s.total_views AS DOUBLE), 0.0), 1.0) / greatest(coalesce(CAST(s.subscriber_count AS DOUBLE), 1.0), 1.0)
      AS f1_efficiency,
    coalesce(CAST(s.total_likes AS DOUBLE), 0.0) / greatest(coalesce(CAST(s.total_views AS DOUBLE), 0.0), 1.0) AS f2_loyalty,
    coalesce(CAST(s.total_comments AS DOUBLE), 0.0) / greatest(coalesce(CAST(s.total_views AS DOUBLE), 0.0), 1.0) AS f3_depth,
    greatest(coalesce(CAST(s.total_views AS DOUBLE), 0.0), 1.0) / greatest(coalesce(CAST(s.total_videos_crawled AS DOUBLE), 1.0), 1.0)
      AS f6_avg_views,
    (coalesce(CAST(s.total_likes AS DOUBLE), 0.0) + 2 * coalesce(CAST(s.total_comments AS DOUBLE), 0.0))
      / greatest(coalesce(CAST(s.total_views AS DOUBLE), 0.0), 1.0) AS f7_engagement,
    log10(greatest(coalesce(CAST(s.subscriber_count AS DOUBLE), 1.0), 1.0)) AS f9_sub_tier,
    coalesce(c.f4, 0.0) AS f4_consistency, coalesce(t.f11, 1.0) AS f11_recent_trend
  FROM summary s LEFT JOIN cons c ON s.channel_id = c.channel_id LEFT JOIN trend t ON s.channel_id = t.channel_id)"""

_OF = EF.OWNER_FEATURES


def _owner_feats(spark, sf):
    b = base(spark, sf)
    return EF.owner_features(b["enhanced"], b["channel_summary"])


@register("m14_owner_features", with_ctes("summary", extra=OWNER_FEAT_SQL) + "SELECT * FROM ofeat", _OF)
def q_m14(spark, sf):
    """M14 owner features incl. publish-gap consistency (W09) and latest-5 trend (W08), skew-safe."""
    return _owner_feats(spark, sf)


@register("m15_item_features", with_ctes("enhanced") + """,
oa AS (SELECT channel_id, avg(CAST(view_count AS DOUBLE)) AS a FROM enhanced GROUP BY channel_id)
SELECT e.video_id, e.channel_id,
  coalesce(CAST(like_count AS DOUBLE), 0.0) / greatest(coalesce(CAST(view_count AS DOUBLE), 0.0), 1.0) AS v1_like_ratio,
  coalesce(CAST(comment_count AS DOUBLE), 0.0) / greatest(coalesce(CAST(view_count AS DOUBLE), 0.0), 1.0) AS v2_comment_ratio,
  coalesce(CAST(like_count AS DOUBLE), 0.0) / greatest(coalesce(CAST(comment_count AS DOUBLE), 0.0), 1.0) AS v3_like_comment_ratio,
  coalesce(CAST(duration_seconds AS DOUBLE), 0.0) / 60 AS v4_duration_mins,
  coalesce(CAST(view_count AS DOUBLE), 0.0) / greatest(coalesce(oa.a, 1.0), 1.0) AS v5_relative_views,
  (coalesce(CAST(like_count AS DOUBLE), 0.0) + 2 * coalesce(CAST(comment_count AS DOUBLE), 0.0))
    / greatest(coalesce(CAST(view_count AS DOUBLE), 0.0), 1.0) * 100 AS v6_engagement_score,
  ln(1 + coalesce(CAST(view_count AS DOUBLE), 0.0) / greatest(coalesce(oa.a, 1.0), 1.0)) AS log_relative_views,
  ln(1 + coalesce(CAST(view_count AS DOUBLE), 0.0)) AS log_views
FROM enhanced e LEFT JOIN oa ON e.channel_id = oa.channel_id""", EF.ITEM_FEATURES)
def q_m15(spark, sf):
    """M15 item features relative to the owner's average."""
    return EF.item_features(base(spark, sf)["enhanced"])


@register("m16_early_signals", """
WITH f AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id),
d AS (SELECT e.user_id, (epoch_us(e.ts) - epoch_us(f.t0)) / 3600e6 AS age FROM events e JOIN f ON e.user_id = f.user_id),
g AS (SELECT user_id, count(*) AS v7_views_at_poll, max(age) AS v8_age_hours,
        CAST(sum(CASE WHEN age <= 6 THEN 1 ELSE 0 END) AS BIGINT) AS e1_views_6h,
        CAST(sum(CASE WHEN age <= 24 THEN 1 ELSE 0 END) AS BIGINT) AS e2_views_24h,
        CAST(sum(CASE WHEN age <= 48 THEN 1 ELSE 0 END) AS BIGINT) AS e3_views_48h FROM d GROUP BY user_id),
h AS (SELECT *, (e2_views_24h - e1_views_6h) / greatest(e1_views_6h, 1) AS e4_growth_rate_6_24,
        (e3_views_48h - e2_views_24h) / greatest(e2_views_24h, 1) AS e5_growth_rate_24_48,
        v7_views_at_poll / greatest(v8_age_hours, 1.0) AS v9_views_per_hour FROM g),
p AS (SELECT avg(v9_views_per_hour) AS v10_channel_hourly_avg FROM h)
SELECT h.*, p.v10_channel_hourly_avg, h.v9_views_per_hour / nullif(p.v10_channel_hourly_avg, 0) AS v11_velocity_ratio
FROM h CROSS JOIN p""", ["v8_age_hours", "e4_growth_rate_6_24", "e5_growth_rate_24_48", "v9_views_per_hour",
                         "v10_channel_hourly_avg", "v11_velocity_ratio"])
def q_m16(spark, sf):
    """M16 early signals from a poll log (events as snapshots)."""
    return EF.early_signals(fx.table(spark, sf, "events"), "user_id", "ts")


# --- owner labels, group stats, tiers, percentile ranks ---------------------------------------

OWNER_LAB_SQL = """
orat AS (
  SELECT s.*, greatest(coalesce(CAST(total_views AS DOUBLE), 0.0), 1.0) / greatest(coalesce(CAST(subscriber_count AS DOUBLE), 1.0), 1.0)
      AS efficiency_ratio,
    coalesce(CAST(total_likes AS DOUBLE), 0.0) / greatest(coalesce(CAST(total_views AS DOUBLE), 0.0), 1.0) AS loyalty_ratio,
    coalesce(CAST(total_comments AS DOUBLE), 0.0) / greatest(coalesce(CAST(total_views AS DOUBLE), 0.0), 1.0) AS depth_ratio,
    greatest(coalesce(CAST(total_views AS DOUBLE), 0.0), 1.0) / greatest(coalesce(CAST(total_videos_crawled AS DOUBLE), 1.0), 1.0)
      AS avg_views_per_video_r
  FROM summary s),
gq AS (SELECT quantile_cont(efficiency_ratio, 0.75) AS ge, quantile_cont(loyalty_ratio, 0.5) AS gl,
              quantile_cont(avg_views_per_video_r, 0.75) AS ga FROM orat)"""

_OWNER_OUT = """channel_id, channel_name, country_code, subscriber_count, channel_created_at, total_videos_crawled,
  total_views, total_likes, total_comments, avg_like_rate_pct, avg_comment_rate_pct,
  avg_video_duration_seconds, latest_video_date, earliest_video_date, avg_days_between_uploads, last_crawled_at,
  efficiency_ratio, loyalty_ratio, depth_ratio, avg_views_per_video_r AS avg_views_per_video"""

_OWNER_DOUBLES = ["avg_like_rate_pct", "avg_comment_rate_pct", "avg_video_duration_seconds", "avg_days_between_uploads",
                  "efficiency_ratio", "loyalty_ratio", "depth_ratio", "avg_views_per_video",
                  "efficiency_ratio_threshold", "loyalty_ratio_threshold", "avg_views_per_video_threshold"]


@register("c07_owner_labels_global", with_ctes("summary", extra=OWNER_LAB_SQL) + f"""
SELECT {_OWNER_OUT}, ge AS efficiency_ratio_threshold, gl AS loyalty_ratio_threshold,
  ga AS avg_views_per_video_threshold, cm AS conditions_met, CAST(cm >= 2 AS INTEGER) AS is_viral_owner
FROM (SELECT *, CAST(coalesce(CAST(efficiency_ratio > ge AS INTEGER), 0) + coalesce(CAST(loyalty_ratio > gl AS INTEGER), 0)
                + coalesce(CAST(avg_views_per_video_r > ga AS INTEGER), 0) AS INTEGER) AS cm FROM orat CROSS JOIN gq)""",
          _OWNER_DOUBLES)
def q_c07(spark, sf):
    """C07 owner labels: >= 2 of 3 ratios above global p75 / median / p75."""
    return L.owner_labels(base(spark, sf)["channel_summary"])


@register("c07_owner_labels_by_group", with_ctes("summary", "owners", extra=OWNER_LAB_SQL) + f""",
og AS (SELECT r.*, o.country_code || '/' || o.segment AS owner_group FROM orat r
       LEFT JOIN owners o ON r.channel_id = o.channel_id),
wq AS (SELECT owner_group, count(*) AS gn, quantile_cont(efficiency_ratio, 0.75) AS we,
              quantile_cont(loyalty_ratio, 0.5) AS wl, quantile_cont(avg_views_per_video_r, 0.75) AS wa
       FROM og GROUP BY owner_group),
th AS (SELECT og.*, CASE WHEN wq.gn >= 5 THEN wq.we ELSE gq.ge END AS te,
              CASE WHEN wq.gn >= 5 THEN wq.wl ELSE gq.gl END AS tl,
              CASE WHEN wq.gn >= 5 THEN wq.wa ELSE gq.ga END AS ta
       FROM og LEFT JOIN wq ON og.owner_group IS NOT DISTINCT FROM wq.owner_group CROSS JOIN gq)
SELECT {_OWNER_OUT}, owner_group, te AS efficiency_ratio_threshold, tl AS loyalty_ratio_threshold,
  ta AS avg_views_per_video_threshold, cm AS conditions_met, CAST(cm >= 2 AS INTEGER) AS is_viral_owner
FROM (SELECT *, CAST(coalesce(CAST(efficiency_ratio > te AS INTEGER), 0) + coalesce(CAST(loyalty_ratio > tl AS INTEGER), 0)
                + coalesce(CAST(avg_views_per_video_r > ta AS INTEGER), 0) AS INTEGER) AS cm FROM th)""",
          _OWNER_DOUBLES)
def q_c07_group(spark, sf):
    """C07 + W04 owner labels with within-group thresholds, global fallback for groups under 5."""
    b = base(spark, sf)
    ow = fx.owners(spark, sf).select("channel_id", F.concat_ws("/", "country_code", "segment").alias("owner_group"))
    return L.owner_labels(b["channel_summary"].join(ow, "channel_id", "left"), group_col="owner_group")


def _zlabels(spark, sf):
    return L.zscore_labels(base(spark, sf)["engagement"], fx.AS_OF)


ZSCORE_SQL = f"""
cs AS (SELECT channel_id, avg(view_count) AS a, stddev_samp(view_count) AS s FROM engagement GROUP BY channel_id),
ga AS (SELECT avg(view_count) AS gavg FROM engagement),
z0 AS (SELECT e.*, CASE WHEN e.channel_id IS NULL THEN ga.gavg ELSE coalesce(cs.a, ga.gavg) END AS channel_avg_views,
         greatest(coalesce(CASE WHEN e.channel_id IS NOT NULL THEN cs.s END, 1.0), 1.0) AS channel_std_views
       FROM engagement e LEFT JOIN cs ON e.channel_id = cs.channel_id CROSS JOIN ga),
z1 AS (SELECT *, coalesce((view_count - channel_avg_views) / channel_std_views, 0.0) AS relative_score,
         greatest((epoch_us({fx.AS_OF!r}::TIMESTAMP) - epoch_us(published_at)) / 86400e6, 0.1) AS video_age_days
       FROM z0),
zl AS (SELECT *, CAST(relative_score > 1.5 AS INTEGER) AS is_viral, view_count / video_age_days AS views_per_day,
         channel_avg_views / 30 AS channel_daily_avg,
         CASE WHEN coalesce(view_count / video_age_days > channel_avg_views / 30 * 3.0, false) THEN 'viral_within_7d'
              WHEN coalesce(view_count / video_age_days > channel_avg_views / 30 * 1.5, false) THEN 'viral_within_30d'
              ELSE 'not_viral' END AS time_window_label
       FROM z1)"""

_Z_DOUBLES = ["like_rate_pct", "comment_rate_pct", "engagement_score", "avg_views_per_day", "channel_avg_views",
              "channel_std_views", "relative_score", "video_age_days", "views_per_day", "channel_daily_avg"]


@register("c08_zscore_labels", with_ctes("engagement", extra=ZSCORE_SQL) + "SELECT * FROM zl", _Z_DOUBLES)
def q_c08(spark, sf):
    """C08 + W02 item z-score label within owner and time-window label."""
    return _zlabels(spark, sf)


@register("a27_simplify_classes", with_ctes("engagement", extra=ZSCORE_SQL) + """,
mn AS (SELECT min(n) AS m FROM (SELECT time_window_label, count(*) AS n FROM zl GROUP BY 1))
SELECT video_id, CASE WHEN mn.m < 3 AND time_window_label <> 'not_viral' THEN 'viral' ELSE time_window_label END
  AS time_window_label FROM zl CROSS JOIN mn""")
def q_a27(spark, sf):
    """A27 collapse the time-window classes to two when the rarest has fewer than 3 rows."""
    z = _zlabels(spark, sf).select("video_id", "time_window_label")
    return PR.simplify_classes(z, "time_window_label")


_STAT_COLS = ["count", "viral_rate"] + [f"{p}_{f}" for f in _OF for p in ("median", "min", "p25", "p50", "p75", "max")]
_STAT_DOUBLES = ["viral_rate"] + [f"{p}_{f}" for f in _OF for p in ("median", "min", "p25", "p50", "p75", "max")]


def _group_stats_sql() -> str:
    parts = []
    for f in _OF:
        parts.append(f"quantile_cont({f}, 0.5) AS median_{f}")
        for p, expr in (("min", f"CAST(min({f}) AS DOUBLE)"), ("p25", f"quantile_cont({f}, 0.25)"),
                        ("p50", f"quantile_cont({f}, 0.5)"), ("p75", f"quantile_cont({f}, 0.75)"),
                        ("max", f"CAST(max({f}) AS DOUBLE)")):
            parts.append(f"CASE WHEN count(*) < 3 THEN NULL ELSE {expr} END AS {p}_{f}")
    return ("gs AS (SELECT segment, count(*) AS count, avg(CAST(is_viral_owner AS DOUBLE)) AS viral_rate, "
            + ", ".join(parts) + " FROM ofl GROUP BY segment)")


GROUP_STATS_SQL = OWNER_FEAT_SQL + "," + OWNER_LAB_SQL + """,
olab AS (SELECT channel_id, CAST(coalesce(CAST(efficiency_ratio > ge AS INTEGER), 0)
           + coalesce(CAST(loyalty_ratio > gl AS INTEGER), 0) + coalesce(CAST(avg_views_per_video_r > ga AS INTEGER), 0) >= 2
           AS INTEGER) AS is_viral_owner FROM orat CROSS JOIN gq),
ofl AS (SELECT f.*, o.segment, l.is_viral_owner FROM ofeat f LEFT JOIN owners o ON f.channel_id = o.channel_id
        LEFT JOIN olab l ON f.channel_id = l.channel_id),
""" + _group_stats_sql()


def _owner_frame(spark, sf):
    seg = fx.owners(spark, sf).select("channel_id", "segment")
    return shared(spark, sf, "owner-segments", lambda: owner_features(spark, sf).join(seg, "channel_id", "left").join(
        owner_labels(spark, sf), "channel_id", "left"))


def _group_stats(spark, sf):
    return PR.group_stats(_owner_frame(spark, sf), "segment", _OF, label="is_viral_owner", reread=True)


@register("a20_group_stats", with_ctes("summary", "owners", extra=GROUP_STATS_SQL) + "SELECT * FROM gs", _STAT_DOUBLES)
def q_a20(spark, sf):
    """A20 per-group (segment) count, positive rate, medians and min/p25/p50/p75/max per owner feature."""
    return _group_stats(spark, sf)


@register("w06_rank_tiers", with_ctes("summary", "owners", extra=GROUP_STATS_SQL) + """
SELECT segment, median_f9_sub_tier, CAST(rk AS INTEGER) AS tier_rank,
  ['Mega Channels (100M+ sub)', 'Large Channels (1M–100M sub)', 'Growing Channels (100K–1M sub)',
   'Niche Channels (<100K sub)', 'Micro Channels'][least(rk, 4) + 1] AS tier_name
FROM (SELECT segment, median_f9_sub_tier,
        row_number() OVER (ORDER BY median_f9_sub_tier DESC NULLS LAST, segment) - 1 AS rk FROM gs)""",
          ["median_f9_sub_tier"])
def q_w06(spark, sf):
    """W06 groups ranked by median subscriber tier and named, capped at the last tier name."""
    st = _group_stats(spark, sf).select("segment", "median_f9_sub_tier")
    return PR.rank_tiers(st, "segment", "median_f9_sub_tier").withColumn("tier_rank", F.col("tier_rank").cast("int"))


@register("w05_within_group_percentile", with_ctes("summary", "owners", extra=GROUP_STATS_SQL) + """
SELECT f.channel_id, f.segment, f.f6_avg_views,
  CASE WHEN g.min_f6_avg_views IS NULL OR g.p25_f6_avg_views IS NULL OR g.p50_f6_avg_views IS NULL
         OR g.p75_f6_avg_views IS NULL OR g.max_f6_avg_views IS NULL THEN 50.0
       WHEN f.f6_avg_views <= g.min_f6_avg_views THEN 0.0
       WHEN f.f6_avg_views >= g.max_f6_avg_views THEN 100.0
       WHEN f.f6_avg_views BETWEEN g.min_f6_avg_views AND g.p25_f6_avg_views THEN
         CASE WHEN g.min_f6_avg_views = g.p25_f6_avg_views THEN 0.0
              ELSE (f.f6_avg_views - g.min_f6_avg_views) / (g.p25_f6_avg_views - g.min_f6_avg_views) * 25 END
       WHEN f.f6_avg_views BETWEEN g.p25_f6_avg_views AND g.p50_f6_avg_views THEN
         CASE WHEN g.p25_f6_avg_views = g.p50_f6_avg_views THEN 25.0
              ELSE 25 + (f.f6_avg_views - g.p25_f6_avg_views) / (g.p50_f6_avg_views - g.p25_f6_avg_views) * 25 END
       WHEN f.f6_avg_views BETWEEN g.p50_f6_avg_views AND g.p75_f6_avg_views THEN
         CASE WHEN g.p50_f6_avg_views = g.p75_f6_avg_views THEN 50.0
              ELSE 50 + (f.f6_avg_views - g.p50_f6_avg_views) / (g.p75_f6_avg_views - g.p50_f6_avg_views) * 25 END
       WHEN f.f6_avg_views BETWEEN g.p75_f6_avg_views AND g.max_f6_avg_views THEN
         CASE WHEN g.p75_f6_avg_views = g.max_f6_avg_views THEN 75.0
              ELSE 75 + (f.f6_avg_views - g.p75_f6_avg_views) / (g.max_f6_avg_views - g.p75_f6_avg_views) * 25 END
       ELSE 50.0 END AS pct_rank_in_group
FROM ofl f LEFT JOIN gs g ON f.segment IS NOT DISTINCT FROM g.segment""", ["f6_avg_views", "pct_rank_in_group"])
def q_w05(spark, sf):
    """W05 piecewise-linear percentile rank of an owner within its group."""
    o = _owner_frame(spark, sf)
    st = _group_stats(spark, sf)
    j = o.select("channel_id", "segment", "f6_avg_views").join(st, "segment", "left")
    c = F.col
    return j.select("channel_id", "segment", "f6_avg_views", PR.percentile_rank(
        c("f6_avg_views"), c("min_f6_avg_views"), c("p25_f6_avg_views"), c("p50_f6_avg_views"),
        c("p75_f6_avg_views"), c("max_f6_avg_views")).alias("pct_rank_in_group"))


@register("a22_owner_kpis", with_ctes("items") + """
SELECT channel_id, count(*) AS n_items, CAST(floor(sum(view_count) / count(*)) AS BIGINT) AS avg_views,
  avg(CASE WHEN view_count = 0 THEN 0.0 ELSE (like_count + comment_count) / view_count * 100 END) AS avg_engagement_rate,
  CASE WHEN sum(view_count) > 0 THEN sum(like_count) / sum(view_count) * 100 ELSE 0.0 END AS like_rate,
  CASE WHEN sum(view_count) > 0 THEN sum(comment_count) / sum(view_count) * 100 ELSE 0.0 END AS comment_rate,
  arg_max(title, (CASE WHEN view_count = 0 THEN 0.0 ELSE (like_count + comment_count) / view_count * 100 END, video_id))
    AS best_title
FROM items GROUP BY channel_id""", ["avg_engagement_rate", "like_rate", "comment_rate"])
def q_a22(spark, sf):
    """A22 / C17 owner KPIs incl. the best item by engagement rate."""
    return PR.owner_kpis(fx.items(spark, sf))


@register("a29_pivot_shares", """
SELECT l_suppkey AS supplier_key,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS flag_A,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS flag_N,
  sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_quantity END) AS flag_other
FROM lineitem GROUP BY l_suppkey""", ["flag_A", "flag_N", "flag_other"])
def q_a29(spark, sf):
    """A29 pivot of a long share table to one column per listed value."""
    li = fx.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "supplier_key")
    return PR.pivot_shares(li, ["supplier_key"], "l_returnflag", ["A", "N"], "l_quantity", prefix="flag_")


# --- data quality ---------------------------------------------------------------------------------

def _suite(spark, sf):
    items = marts.fact(base(spark, sf)["enhanced"], extra=["days_since_published"])
    cust = fx.table(spark, sf, "customer")
    relations = {"items": items, "orders": fx.table(spark, sf, "orders"), "lineitem": fx.table(spark, sf, "lineitem"),
                 "control": fx.control_table(spark, sf), "customers": cust,
                 "building_customers": cust.where(F.col("c_mktsegment") == "BUILDING")}
    aged = F.col("days_since_published") > 0      # the engagement relation holds these items only
    rules = [
        Q.Rule("unique_item_id", "items", key=["video_id"]),
        Q.Rule("unique_lineitem_key", "lineitem", key=["l_orderkey", "l_linenumber"]),
        Q.Rule("not_null_owner", "items", F.col("channel_id").isNull()),
        Q.Rule("fk_items_owners", "items", key=["channel_id"], parent=("customers", "c_custkey")),
        Q.Rule("fk_lineitem_orders", "lineitem", key=["l_orderkey"], parent=("orders", "o_orderkey")),
        Q.Rule("fk_orders_building_customers", "orders", key=["o_custkey"], parent=("building_customers", "c_custkey"),
               severity="warn"),
        Q.Rule("accepted_engagement_level", "items", Q.outside_values("engagement_level", ["low", "medium", "high"], aged)),
        Q.Rule("accepted_length_class", "items",
               Q.outside_values("video_length_category", ["shorts", "short", "medium", "long"])),
        Q.Rule("accepted_status_urgent_only", "orders",
               Q.outside_values("o_orderstatus", ["F", "O"], F.col("o_orderpriority") == "1-URGENT"), severity="warn"),
        Q.Rule("range_like_rate", "items", aged & Q.outside_range("like_rate_pct", 0, 100)),
        Q.Rule("range_days_open", "items", aged & Q.outside_range("days_since_published", 0, None, inclusive=False)),
        Q.Rule("non_negative_statistics", "items", Q.any_negative(["view_count", "like_count", "comment_count"])),
        Q.Rule("valid_engagement_rates", "items", aged & Q.invalid_rates()),
        Q.Rule("formula_self_check", "items", Q.formula_differs()),
        Q.Rule("stale_control_rows", "control", Q.stale(fx.AS_OF), severity="warn"),
    ]
    return rules, relations


SUITE_SQL = with_ctes("fact", extra=CONTROL_SQL) + f"""
SELECT *, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'warn' THEN 'warn' ELSE 'fail' END AS status FROM (
SELECT 'unique_item_id' AS check_name, 'error' AS severity, (SELECT count(*) FROM (SELECT video_id FROM fact
  WHERE video_id IS NOT NULL GROUP BY video_id HAVING count(*) > 1)) AS failures
UNION ALL SELECT 'unique_lineitem_key', 'error', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'not_null_owner', 'error', (SELECT count(*) FROM fact WHERE channel_id IS NULL)
UNION ALL SELECT 'fk_items_owners', 'error', (SELECT count(*) FROM fact WHERE channel_id IS NOT NULL
  AND channel_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL))
UNION ALL SELECT 'fk_lineitem_orders', 'error', (SELECT count(*) FROM lineitem WHERE l_orderkey IS NOT NULL
  AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL))
UNION ALL SELECT 'fk_orders_building_customers', 'warn', (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IS NOT NULL))
UNION ALL SELECT 'accepted_engagement_level', 'error', (SELECT count(*) FROM engagement WHERE engagement_level IS NOT NULL
  AND engagement_level NOT IN ('low', 'medium', 'high'))
UNION ALL SELECT 'accepted_length_class', 'error', (SELECT count(*) FROM fact WHERE video_length_category IS NOT NULL
  AND video_length_category NOT IN ('shorts', 'short', 'medium', 'long'))
UNION ALL SELECT 'accepted_status_urgent_only', 'warn', (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
  AND o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O'))
UNION ALL SELECT 'range_like_rate', 'error', (SELECT count(*) FROM engagement WHERE like_rate_pct < 0 OR like_rate_pct > 100)
UNION ALL SELECT 'range_days_open', 'error', (SELECT count(*) FROM engagement WHERE days_since_published <= 0)
UNION ALL SELECT 'non_negative_statistics', 'error', (SELECT count(*) FROM fact WHERE view_count < 0 OR like_count < 0
  OR comment_count < 0)
UNION ALL SELECT 'valid_engagement_rates', 'error', (SELECT count(*) FROM engagement WHERE engagement_score < 0
  OR like_rate_pct > 100 OR like_rate_pct < 0 OR comment_rate_pct > 100 OR comment_rate_pct < 0)
UNION ALL SELECT 'formula_self_check', 'error', (SELECT count(*) FROM fact WHERE abs(
  CASE WHEN view_count = 0 THEN 0.0 ELSE (like_count + comment_count) / view_count * 100 END
  - (like_count + comment_count) / CASE WHEN view_count > 0 THEN view_count ELSE 1 END * 100) > 0.001)
UNION ALL SELECT 'stale_control_rows', 'warn', (SELECT count(*) FROM control WHERE last_crawl_ts IS NULL
  OR (epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(last_crawl_ts)) / 3600e6 > 48))"""


@register("q10_quality_suite", SUITE_SQL)
def q_q10(spark, sf):
    """Q01–Q07, Q09, Q11 as one suite: failing-row count and status per check."""
    return Q.run_rules(*_suite(spark, sf))


@register("q03_orphan_rows", """
SELECT * FROM orders WHERE o_custkey IS NOT NULL
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IS NOT NULL)""",
          ["o_totalprice"])
def q_q03(spark, sf):
    """Q03 relationships check: failing (orphan) rows against a deliberately filtered parent."""
    cust = fx.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return Q.relationships(fx.table(spark, sf, "orders"), "o_custkey", cust, "c_custkey")


@register("q09_freshness", "WITH " + CONTROL_SQL.strip() + """
SELECT * FROM (SELECT channel_id, channel_name,
  (epoch_us(TIMESTAMP '2001-08-02 00:00:00') - epoch_us(last_crawl_ts)) / 3600e6 AS hours_old FROM control)
WHERE hours_old IS NULL OR hours_old > 48""", ["hours_old"])
def q_q09(spark, sf):
    """Q09 stale control rows (never run counts stale)."""
    return Q.freshness(fx.control_table(spark, sf), fx.AS_OF)


@register("q12_join_drift", with_ctes("items") + """
SELECT (SELECT count(*) FROM items) AS n_before,
  (SELECT count(*) FROM items i JOIN orders o ON i.channel_id = o.o_custkey) AS n_after,
  (SELECT count(*) FROM items i JOIN orders o ON i.channel_id = o.o_custkey) - (SELECT count(*) FROM items) AS delta,
  (SELECT count(*) FROM items i JOIN orders o ON i.channel_id = o.o_custkey) <> (SELECT count(*) FROM items) AS drift""")
def q_q12(spark, sf):
    """Q12 row-count drift of a fan-out join (items joined to all orders of their owner)."""
    return Q.join_drift(fx.items(spark, sf), fx.table(spark, sf, "orders").withColumnRenamed("o_custkey", "channel_id"), ["channel_id"])


# --- A18 / A19 / A21 / W07 / C16 ------------------------------------------------------------------

from .catalog_ops import LABEL_SQL  # noqa: E402


def _labeled(spark, sf):
    b = base(spark, sf)
    return L.viral_label(b["engagement"], b["channel_summary"])


@register("a18_class_weights", with_ctes("engagement", "summary", extra=LABEL_SQL) + """,
c AS (SELECT is_viral, count(*) AS n FROM labeled GROUP BY is_viral),
t AS (SELECT sum(n) AS tot, count(*) AS k, sum(CASE WHEN is_viral = 0 THEN n END) AS neg,
             sum(CASE WHEN is_viral = 1 THEN n END) AS pos FROM c)
SELECT is_viral, n, tot / (k * n) AS balanced_weight, neg / nullif(pos, 0) AS scale_pos_weight FROM c CROSS JOIN t""",
          ["balanced_weight", "scale_pos_weight"])
def q_a18(spark, sf):
    """A18 class balance: n_neg / n_pos and 'balanced' weights n / (k n_c)."""
    return L.class_weights(_labeled(spark, sf), "is_viral")


@register("a19_label_distribution", with_ctes("engagement", extra=ZSCORE_SQL) + """
SELECT time_window_label, count(*) AS n, count(*) / (SELECT count(*) FROM zl) * 100 AS pct,
  NOT ((SELECT avg(CASE WHEN time_window_label <> 'not_viral' THEN 100.0 ELSE 0.0 END) FROM zl) BETWEEN 20 AND 80) AS balance_warning
FROM zl GROUP BY time_window_label""", ["pct"])
def q_a19(spark, sf):
    """A19 distribution report: count and share per label value."""
    return L.label_distribution(_zlabels(spark, sf), "time_window_label")


def _a21_sql() -> str:
    parts = [f"SELECT '{f}' AS feature, quantile_cont({f}, 0.25) AS p25, quantile_cont({f}, 0.5) AS p50, "
             f"quantile_cont({f}, 0.75) AS p75, avg({f}) AS mean, CAST(min({f}) AS DOUBLE) AS min, "
             f"CAST(max({f}) AS DOUBLE) AS max, stddev_samp({f}) AS std FROM ofeat" for f in _OF]
    return with_ctes("summary", extra=OWNER_FEAT_SQL) + "\nUNION ALL\n".join(parts)


@register("a21_feature_stats", _a21_sql(), ["p25", "p50", "p75", "mean", "min", "max", "std"])
def q_a21(spark, sf):
    """A21 global per-feature stats (p25 / p50 / p75 / mean / min / max / std) in one unpivoted pass."""
    from ..operators.quantiles import quantiles_long
    o = _owner_feats(spark, sf)
    q = quantiles_long(o, _OF, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    long = o.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"))
                                       for f in _OF])).alias("kv")).select("kv.*")
    m = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
                                    F.stddev_samp("v").alias("std"))
    return q.join(m, "feature")


@register("w07_minmax_percentile", with_ctes("summary", extra=OWNER_FEAT_SQL) + """,
r AS (SELECT min(f6_avg_views) AS lo, max(f6_avg_views) AS hi FROM ofeat)
SELECT channel_id, CASE WHEN hi > lo THEN least(greatest((f6_avg_views - lo) / (hi - lo) * 100, 0.0), 100.0)
                        ELSE 50.0 END AS pct_of_range FROM ofeat CROSS JOIN r""", ["pct_of_range"])
def q_w07(spark, sf):
    """W07 min-max percentile of an owner feature clipped to 0..100."""
    from ..operators.tables import attach_scalars
    o = _owner_feats(spark, sf)
    r = o.agg(F.min("f6_avg_views").alias("_lo"), F.max("f6_avg_views").alias("_hi"))
    j = attach_scalars(o, r)
    return j.select("channel_id", PR.minmax_percentile(F.col("f6_avg_views"), F.col("_lo"), F.col("_hi"))
                    .alias("pct_of_range"))


_FILL = ["avg_days_between_uploads", "avg_video_duration_seconds", "avg_like_rate_pct"]


@register("c16_fill_missing", with_ctes("summary") + ",\nmed AS (SELECT " + ", ".join(
    f"coalesce(quantile_cont({c}, 0.5), 0.0) AS m_{c}" for c in _FILL) + " FROM summary)\nSELECT channel_id, " + ", ".join(
    f"CASE WHEN {c} IS NULL OR isnan({c}) THEN m_{c} ELSE {c} END AS {c}" for c in _FILL) + " FROM summary CROSS JOIN med",
          _FILL)
def q_c16(spark, sf):
    """C16 imputation: NULL / NaN numeric columns filled with exact training medians."""
    from ..operators import features as FE
    s = base(spark, sf)["channel_summary"].select("channel_id", *_FILL)
    return FE.fill_missing(s, _FILL)
