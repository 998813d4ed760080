"""Catalog entries for the arithmetic after a model (C17-C26, F24): scored rows with a given probability, so that SQL can say
what must come out. The probability, window and growth are taken from the item's view count."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import scoring as SC
from ..sources import fixtures as fx
from .catalog import base, register
from .oracle import with_ctes

GIVEN_SQL = f"""
g AS (SELECT i.video_id, i.view_count, i.like_count, i.comment_count, s.avg_views_per_video AS owner_avg_views, s.subscriber_count,
        CAST(i.view_count * 7919 % 1000 AS DOUBLE) / 1000 AS p0, CAST(i.view_count % 40 AS DOUBLE) / 10 AS growth,
        i.view_count % 4 = 0 AS has_early, CASE WHEN i.view_count % 11 <> 0 THEN CAST(i.view_count % 10 AS DOUBLE) / 10 END AS prior,
        CASE i.view_count % 3 WHEN 0 THEN 'not_viral' WHEN 1 THEN 'viral_within_7d' ELSE 'viral_within_30d' END AS window0,
        CAST(epoch_us(TIMESTAMP '{fx.AS_OF}') - epoch_us(i.published_at) AS DOUBLE) / 3600e6 AS age_hours
      FROM items i LEFT JOIN summary s ON i.channel_id = s.channel_id),
h AS (SELECT *, view_count / greatest(age_hours, 1.0) * 400 AS views_per_hour, p0 > 0.5 AS will0 FROM g),
k AS (SELECT *, CASE WHEN NOT will0 AND p0 > 0.4 THEN 'LOW VIRAL POTENTIAL' WHEN NOT will0 THEN 'NOT VIRAL'
        WHEN window0 = 'viral_within_7d' THEN 'VIRAL WITHIN 7 DAYS' WHEN window0 = 'viral_within_30d' THEN 'VIRAL WITHIN 30 DAYS'
        ELSE 'VIRAL POTENTIAL' END AS label0,
        CASE WHEN views_per_hour > 100000 THEN 0.82 WHEN views_per_hour > 30000 THEN 0.65 WHEN views_per_hour > 10000 THEN 0.5
          WHEN views_per_hour > 2000 THEN 0.35 ELSE 0.0 END AS floor1,
        CASE WHEN view_count > 5000000 THEN 0.6 ELSE 0.0 END AS floor2 FROM h),
m AS (SELECT *, greatest(p0, floor1, floor2) AS b, greatest(p0, floor1, floor2) <> p0 AS up FROM k),
n AS (SELECT *, CASE WHEN up THEN round(b, 4) ELSE p0 END AS p, will0 OR (up AND b >= 0.6) AS will_viral,
        CASE WHEN up AND b >= 0.6 AND NOT will0 THEN 'VIRAL POTENTIAL' ELSE label0 END AS label,
        CASE WHEN up AND b >= 0.65 AND window0 = 'not_viral' THEN 'viral_within_30d' ELSE window0 END AS time_window,
        views_per_hour / greatest(owner_avg_views / 720, 1.0) AS velocity_ratio FROM m),
o AS (SELECT *, CAST(floor(view_count + views_per_hour * 24 * 7 * (1 + p) * CASE WHEN time_window = 'viral_within_7d' THEN 0.7 ELSE 0.4 END)
        AS BIGINT) AS views_7d,
        least(100, greatest(0, 50 + CAST(trunc((p - 0.5) * 60) AS INTEGER)
          + CASE WHEN velocity_ratio > 3 THEN 20 WHEN velocity_ratio > 1.5 THEN 10 WHEN velocity_ratio < 0.5 THEN -15 ELSE 0 END
          + CASE WHEN growth > 2 THEN 15 WHEN growth > 0.5 THEN 5 ELSE 0 END)) AS momentum FROM n)"""

_DOUBLES = ["probability", "blended", "engagement_rate", "velocity_ratio", "vs_avg_pct"]


@register("c18_c26_scored_items", with_ctes("items", "summary", extra=GIVEN_SQL) + """
SELECT video_id, p AS probability, will_viral, label, time_window, views_7d, momentum,
  CASE WHEN momentum >= 70 THEN 'ACCELERATING' WHEN momentum >= 50 THEN 'STABLE' ELSE 'SLOWING' END AS momentum_label,
  CASE WHEN p > 0.75 THEN 'HIGH' WHEN p > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS projection_confidence,
  CASE WHEN p >= 0.75 THEN 'boost_now' WHEN p >= 0.5 THEN 'watch' WHEN p >= 0.3 THEN 'improve' ELSE 'unlikely' END AS recommendation,
  CASE WHEN p >= 0.85 THEN 'EXTREMELY HIGH' WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.55 THEN 'MEDIUM' WHEN p >= 0.4 THEN 'LOW'
    ELSE 'VERY LOW' END AS probability_label,
  CASE WHEN p >= 0.8 OR p <= 0.2 THEN 'high' WHEN p >= 0.65 OR p <= 0.35 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN growth > 1.05 THEN 'growing' WHEN growth < 0.95 THEN 'declining' ELSE 'stable' END AS trend,
  0.7 * p + 0.3 * coalesce(prior, 0.5) AS blended, velocity_ratio, (velocity_ratio - 1) * 100 AS vs_avg_pct,
  least(99, greatest(1, CAST(trunc(50 * least(velocity_ratio, 2.0)) AS INTEGER))) AS pace_percentile,
  CASE WHEN has_early AND age_hours > 48 THEN 'HIGH' WHEN has_early OR age_hours > 6 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN coalesce(view_count, 0) = 0 THEN 0.0 ELSE CAST(like_count + comment_count AS DOUBLE) / view_count * 100 END AS engagement_rate,
  concat_ws(',', CASE WHEN age_hours / 24 <= 1 THEN 'new_item_under_24h' END, CASE WHEN subscriber_count IS NULL THEN 'hidden_subscribers' END,
    CASE WHEN like_count IS NULL THEN 'hidden_likes' END, CASE WHEN coalesce(view_count, 0) = 0 THEN 'no_views' END) AS warnings
FROM o""", _DOUBLES)
def q_scored(spark, sf):
    """C17-C22, C24-C26 and the bands of F24 over items with a given probability, window and growth."""
    own = base(spark, sf)["channel_summary"].select("channel_id", F.col("avg_views_per_video").alias("owner_avg_views"),
                                                    "subscriber_count")
    v = F.col("view_count")
    age = (F.unix_micros(F.lit(fx.AS_OF).cast("timestamp")) - F.unix_micros("published_at")) / F.lit(3600e6)
    d = (fx.items(spark, sf).select("video_id", "channel_id", "view_count", "like_count", "comment_count", "published_at")
         .join(own, "channel_id", "left")
         .withColumn("probability", (v * 7919 % 1000).cast("double") / 1000).withColumn("growth", (v % 40).cast("double") / 10)
         .withColumn("has_early", v % 4 == 0).withColumn("prior", F.when(v % 11 != 0, (v % 10).cast("double") / 10))
         .withColumn("time_window", F.when(v % 3 == 0, "not_viral").when(v % 3 == 1, "viral_within_7d").otherwise("viral_within_30d"))
         .withColumn("age_hours", age).withColumn("views_per_hour", v / F.greatest(F.col("age_hours"), F.lit(1.0)) * 400)
         .withColumn("will_viral", F.col("probability") > 0.5))
    d = d.withColumn("label", SC.prediction_label(F.col("will_viral"), F.col("probability"), F.col("time_window")))
    d = SC.boost_and_relabel(d)
    projected, pace = SC.project_views(), SC.pace()
    d = d.select("*", *[c.alias(n) for n, c in (projected | pace).items()])
    d = d.withColumn("momentum", SC.momentum(velocity_ratio="velocity_ratio", growth="growth")).withColumn("days", F.col("age_hours") / 24)
    return d.select("video_id", "probability", "will_viral", "label", "time_window", "views_7d", "momentum",
                    SC.momentum_label("momentum").alias("momentum_label"), "projection_confidence",
                    SC.recommendation("probability").alias("recommendation"), SC.probability_label().alias("probability_label"),
                    X.confidence_band("probability").alias("band"), SC.trend("growth").alias("trend"),
                    SC.prior_blend(prior="prior").alias("blended"), "velocity_ratio", "vs_avg_pct", "pace_percentile",
                    SC.item_confidence(F.col("has_early"), F.col("age_hours")).alias("confidence"),
                    SC.engagement_rate().alias("engagement_rate"), F.array_join(SC.warnings(days="days"), ",").alias("warnings"))
