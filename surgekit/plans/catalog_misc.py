"""Catalog entries for column functions over driver tables (F*), control-table maintenance (I01, I04,
I11, S16, T03, P13, P15, P18), scoring (C17–C26, M05, S15) and explanations (C23)."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import control as C
from ..operators import labels as L
from ..operators import scoring as SC
from ..operators import tables as TB
from ..operators.ml import TWO_STAGE_THRESHOLD
from ..session import delete_at_exit, scratch_path
from ..sources import envelopes as EV
from ..sources import fixtures as fx
from ..sources import io as IO
from ..sources import layers as LY
from . import marts
from .catalog import base, owner_features, owner_labels, register, stored_items, stored_summary
from .catalog_ops import CONTROL_SQL, RUNLOG_SQL
from .catalog_staging import BASE as RAW_BASE
from .oracle import with_ctes
from .relations import shared

_STRICT_SQL = r"'^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$'"


def _g(i):
    return f"coalesce(TRY_CAST(nullif(regexp_extract(trim(coalesce(duration_iso8601, '')), {_STRICT_SQL}, {i}), '') AS BIGINT), 0)"


@register("f04_item_functions", with_ctes("items") + f"""
SELECT video_id, duration_iso8601,
  CASE WHEN trim(coalesce(duration_iso8601, '')) <> '' AND regexp_matches(trim(coalesce(duration_iso8601, '')), {_STRICT_SQL})
       THEN {_g(1)} * 86400 + {_g(2)} * 3600 + {_g(3)} * 60 + {_g(4)} ELSE 0 END AS duration_strict_s,
  CASE WHEN floor((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(published_at)) / 86400) > 0
       THEN printf('%d days %d hours', CAST(floor((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(published_at)) / 86400) AS BIGINT),
                   CAST(floor(((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(published_at))
                     - floor((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(published_at)) / 86400) * 86400) / 3600) AS BIGINT))
       ELSE printf('%d hours', CAST(floor(((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(published_at))
                     - floor((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(published_at)) / 86400) * 86400) / 3600) AS BIGINT))
  END AS age_text,
  CASE WHEN category_id IN ('1', '2') THEN 'priority' ELSE 'standard' END AS category_class,
  CASE WHEN CAST(view_count AS DOUBLE) / 500000 >= 0.85 THEN 'EXTREMELY HIGH' WHEN CAST(view_count AS DOUBLE) / 500000 >= 0.70 THEN 'HIGH'
       WHEN CAST(view_count AS DOUBLE) / 500000 >= 0.55 THEN 'MEDIUM' WHEN CAST(view_count AS DOUBLE) / 500000 >= 0.40 THEN 'LOW'
       ELSE 'VERY LOW' END AS share_band
FROM items""")
def q_f04(spark, sf):
    """F04 strict ISO duration, F14 human age, F24 band over a [0,1] share, F26 membership flag."""
    it = fx.items(spark, sf)
    share = F.col("view_count").cast("double") / 500000
    return it.select("video_id", "duration_iso8601", X.iso_duration_strict("duration_iso8601").alias("duration_strict_s"),
                     X.human_age(fx.AS_OF, "published_at").alias("age_text"),
                     F.when(F.col("category_id").isin("1", "2"), F.lit("priority")).otherwise(F.lit("standard"))
                      .alias("category_class"),
                     SC.probability_label(share).alias("share_band"))


@register("f18_url_keys", r"""
SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
  coalesce(CASE WHEN length(trim(url)) = 11 AND NOT contains(trim(url), '/') THEN trim(url) END,
    nullif(regexp_extract(trim(url), '^(?:[a-z]+://)?(?:[^/?#]*\.)?youtu\.be/([^/?#]*)', 1), ''),
    nullif(regexp_extract(trim(url), '^(?:[a-z]+://)?(?:[^/?#]*\.)?youtube\.com(?:/[^?#]*)?\?(?:[^#]*&)?v=([^&#]*)', 1), ''),
    nullif(regexp_extract(trim(url), '^(?:[a-z]+://)?(?:[^/?#]*\.)?youtube\.com/embed/([^/?#]*)', 1), ''), trim(url)) AS url_key
FROM (SELECT page_id, url FROM pages UNION ALL
  SELECT page_id + 1000000, CASE page_id % 5 WHEN 0 THEN 'https://youtu.be/k' || page_id || '?t=3'
    WHEN 1 THEN 'https://www.youtube.com/watch?v=k' || page_id || '&list=a' WHEN 2 THEN 'https://www.youtube.com/watch?list=a&v=k' || page_id
    WHEN 3 THEN 'https://youtube.com/embed/k' || page_id || '?rel=0' ELSE lpad(CAST(page_id AS VARCHAR), 11, 'k') END FROM pages)""")
def q_f18(spark, sf):
    """F18 URL key extraction (id links, else the URL) and host, over the pages' urls and over short, watch and embed links
    and bare ids made from their keys."""
    p = fx.table(spark, sf, "pages").select("page_id", "url")
    k, kind = F.concat(F.lit("k"), F.col("page_id").cast("string")), F.col("page_id") % 5
    made = (F.when(kind == 0, F.concat(F.lit("https://youtu.be/"), k, F.lit("?t=3")))
            .when(kind == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), k, F.lit("&list=a")))
            .when(kind == 2, F.concat(F.lit("https://www.youtube.com/watch?list=a&v="), k))
            .when(kind == 3, F.concat(F.lit("https://youtube.com/embed/"), k, F.lit("?rel=0")))
            .otherwise(F.lpad(F.col("page_id").cast("string"), 11, "k")))
    p = p.unionByName(p.select((F.col("page_id") + 1000000).alias("page_id"), made.alias("url")))
    return p.select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
                    X.extract_url_key("url").alias("url_key"))


@register("f23_crawl_priority", """
WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey AS channel_id, CAST(floor(greatest(c_acctbal, 0.0) * 1000) AS BIGINT) AS subscribers,
  coalesce(n.n, 0) AS videos,
  CASE WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 5000000 THEN 5 WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 1000000 THEN 4
       WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 100000 THEN 3 WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 10000 THEN 2
       ELSE 1 END AS priority,
  CASE WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 1000000 OR coalesce(n.n, 0) / 365 > 1 THEN 12
       WHEN floor(greatest(c_acctbal, 0.0) * 1000) >= 100000 THEN 24 ELSE 48 END AS refresh_hours
FROM customer LEFT JOIN n ON c_custkey = n.o_custkey""")
def q_f23(spark, sf):
    """F23 crawl priority and refresh interval from subscribers and item counts."""
    c = fx.table(spark, sf, "customer")
    n = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("channel_id")).agg(F.count(F.lit(1)).alias("videos"))
    d = c.select(F.col("c_custkey").alias("channel_id"),
                 F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 1000).cast("bigint").alias("subscribers")) \
        .join(n, "channel_id", "left").withColumn("videos", F.coalesce("videos", F.lit(0)).cast("bigint"))
    return d.select("*", X.crawl_priority(F.col("subscribers")).alias("priority"),
                    X.refresh_hours("subscribers", "videos").alias("refresh_hours"))


@register("p13_trending_items", with_ctes("items") + """
SELECT video_id, channel_id, (like_count + comment_count) / view_count * 100 AS engagement_rate FROM items
WHERE coalesce(view_count, 0) <> 0 AND (like_count + comment_count) / view_count * 100 >= 2.0""", ["engagement_rate"])
def q_p13(spark, sf):
    """P13 + C17 trending filter: engagement rate >= 2 %, sorted by rate."""
    it = fx.items(spark, sf).select("video_id", "channel_id", SC.engagement_rate().alias("engagement_rate"))
    return it.where(F.col("engagement_rate") >= 2.0).orderBy(F.desc("engagement_rate"), "video_id")


@register("p15_active_entries", "WITH " + CONTROL_SQL.strip() + """
SELECT channel_id, channel_name, coalesce(priority, 1) AS priority FROM control WHERE coalesce(is_active, true)""")
def q_p15(spark, sf):
    """P15 active entries (default active, priority 1), priority desc; T03 listing order."""
    c = fx.control_table(spark, sf)
    return (c.where(F.coalesce("is_active", F.lit(True)))
             .select("channel_id", "channel_name", F.coalesce("priority", F.lit(1)).alias("priority"))
             .orderBy(F.desc("priority"), "channel_id"))


_NEW_CFG_SQL = """
src AS (SELECT c_custkey AS channel_id, c_name || ' (renamed)' AS channel_name, 6 AS crawl_frequency_hours
        FROM customer WHERE c_mktsegment = 'MACHINERY'
        UNION ALL
        SELECT s_suppkey + 1000000, s_name, 24 FROM supplier)"""


@register("i01_upsert_control", "WITH " + CONTROL_SQL.strip() + "," + _NEW_CFG_SQL + """
SELECT coalesce(c.channel_id, s.channel_id) AS channel_id,
  CASE WHEN s.channel_id IS NOT NULL THEN s.channel_name ELSE c.channel_name END AS channel_name,
  CASE WHEN s.channel_id IS NOT NULL THEN s.crawl_frequency_hours ELSE c.crawl_frequency_hours END AS crawl_frequency_hours,
  c.crawl_status, c.last_crawl_ts, c.next_crawl_ts, c.last_video_published_at, c.is_active, c.priority,
  c.include_comments, c.created_at,
  CASE WHEN s.channel_id IS NOT NULL THEN TIMESTAMP '2001-08-02 12:00:00' ELSE c.updated_at END AS updated_at
FROM control c FULL OUTER JOIN src s ON c.channel_id = s.channel_id""")
def q_i01(spark, sf):
    """I01 + I08 upsert: MACHINERY owners renamed / re-scheduled, suppliers inserted as new owners."""
    ctl = fx.control_table(spark, sf)
    cust = fx.table(spark, sf, "customer").where(F.col("c_mktsegment") == "MACHINERY").select(
        F.col("c_custkey").alias("channel_id"), F.concat("c_name", F.lit(" (renamed)")).alias("channel_name"),
        F.lit(6).alias("crawl_frequency_hours"))
    sup = fx.table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("channel_id"),
                                                F.col("s_name").alias("channel_name"), F.lit(24).alias("crawl_frequency_hours"))
    return TB.upsert(ctl, cust.unionByName(sup), ["channel_id"], ["channel_name", "crawl_frequency_hours"],
                     updated_at=F.lit("2001-08-02 12:00:00").cast("timestamp"))


@register("i04_delete_inactive", "WITH " + CONTROL_SQL.strip() + "," + RUNLOG_SQL.strip() + """
SELECT * FROM runlog WHERE channel_id NOT IN (SELECT channel_id FROM control WHERE NOT is_active)""",
          ["execution_time_seconds"])
def q_i04(spark, sf):
    """I04 delete by key, cascaded to the run log (anti-join)."""
    doomed = fx.control_table(spark, sf).where(~F.col("is_active")).select("channel_id")
    return TB.delete_keys(fx.run_log(spark, sf), doomed, ["channel_id"])


@register("i11_registry_add_or_update", """
WITH reg AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region_key FROM nation),
nw AS (SELECT n_name AS name, n_regionkey + 10 AS region_key FROM nation WHERE n_regionkey = 1
       UNION ALL SELECT r_name, r_regionkey FROM region),
mx AS (SELECT max(id) AS m FROM reg)
SELECT r.id, r.name, coalesce(n.region_key, r.region_key) AS region_key FROM reg r LEFT JOIN nw n ON r.name = n.name
UNION ALL
SELECT CAST(mx.m + row_number() OVER (ORDER BY n.name) AS BIGINT), n.name, n.region_key
FROM nw n CROSS JOIN mx WHERE n.name NOT IN (SELECT name FROM reg)""")
def q_i11(spark, sf):
    """I11 registry add-or-update: known names updated, new names numbered max(id)+1.. in name order."""
    reg = fx.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"),
                                             F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_key"))
    nat = fx.table(spark, sf, "nation").where(F.col("n_regionkey") == 1).select(
        F.col("n_name").alias("name"), (F.col("n_regionkey") + 10).alias("region_key"))
    reg2 = fx.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region_key"))
    return IO.registry_add_or_update(reg, nat.unionByName(reg2), "name", "id", ["region_key"])


@register("s16_seed_today_quota", """
WITH usage AS (SELECT CAST(ts AS DATE) AS date, CAST(count(*) * 5 AS INTEGER) AS quota_used, 10000 AS daily_limit
               FROM events GROUP BY 1)
SELECT * FROM usage
UNION ALL SELECT DATE '2024-01-31', 0, 10000 WHERE NOT EXISTS (SELECT 1 FROM usage WHERE date = DATE '2024-01-31')
UNION ALL SELECT DATE '2024-01-15', 0, 10000 WHERE NOT EXISTS (SELECT 1 FROM usage WHERE date = DATE '2024-01-15')""")
def q_s16(spark, sf):
    """S16 idempotent seed of today's quota row: inserted for a new day, untouched for an existing one."""
    ev = fx.table(spark, sf, "events")
    usage = ev.groupBy(F.to_date("ts").alias("date")).agg((F.count(F.lit(1)) * 5).cast("int").alias("quota_used")) \
        .withColumn("daily_limit", F.lit(10000))
    u = IO.seed_today_quota(usage, F.lit("2024-01-31"))
    return IO.seed_today_quota(u, F.lit("2024-01-15"))


_CONTRACT = T.StructType([T.StructField("video_id", T.StringType()), T.StructField("category_id", T.StringType()),
                          T.StructField("definition", T.StringType()), T.StructField("view_count", T.LongType()),
                          T.StructField("like_count", T.LongType()), T.StructField("has_caption", T.BooleanType()),
                          T.StructField("default_language", T.StringType()),
                          T.StructField("audio_language", T.StringType())])


@register("p18_lenient_flatten", RAW_BASE + """
SELECT video_id, coalesce(category_id, 'unknown') AS category_id, coalesce(definition, 'hd') AS definition,
  coalesce(view_count, 0) AS view_count, coalesce(like_count, 0) AS like_count, coalesce(has_caption, false) AS has_caption,
  coalesce(default_language, json_extract_string(raw, '$.snippet.defaultAudioLanguage')) AS default_language,
  json_extract_string(raw, '$.snippet.defaultAudioLanguage') AS audio_language
FROM stg_flat JOIN rv ON rv.id = stg_flat.video_id""")
def q_p18(spark, sf):
    """P18 + P08 lenient flatten: every raw item conformed to a contract with per-field defaults
    (category 'unknown', definition 'hd', counts 0, caption false, language falls back to audio language)."""
    f = EV.extract_json(EV.raw_videos(spark, sf), "raw", EV.LENIENT_VIDEO_PATHS, keep=[F.col("id").alias("video_id")],
                        strict=False)
    c = IO.conform(f, _CONTRACT, defaults={"category_id": "unknown", "definition": "hd", "view_count": 0,
                                           "like_count": 0, "has_caption": False})
    return c.withColumn("default_language", F.coalesce("default_language", "audio_language"))


# --- scoring (rows-only: depends on a fitted model) ---------------------------------------------

@register("m05_batch_scoring")
def q_m05(spark, sf):
    """M05 batch scoring + C18–C22, C24–C26, F24 and S15 report JSON per scored item."""
    from . import catalog_ml as ml
    from .training import window_scores
    scored = ml.scored(spark, sf, "test").select("video_id", F.col("p_viral").alias("probability"))
    items = marts.fact(stored_items(spark, sf)).select("video_id", "channel_id", "view_count", "like_count", "comment_count",
                             F.col("avg_views_per_day").alias("_vpd"), "published_at")
    own = stored_summary(spark, sf).select("channel_id", F.col("avg_views_per_video").alias("owner_avg_views"),
                                           "subscriber_count")
    d = scored.join(items, "video_id").join(own, "channel_id", "left")
    age_h = X.fractional_days(fx.AS_OF, "published_at") * 24
    d = d.withColumn("age_hours", age_h).withColumn("views_per_hour", F.col("view_count") / F.greatest(age_h, F.lit(1.0)))
    d = d.join(window_scores(spark, sf), "video_id", "left").withColumn("has_early", F.coalesce("has_early", F.lit(False)))
    d = d.withColumn("will_viral", F.col("probability") > 0.5).withColumn("time_window", F.when(
        F.col("probability") > TWO_STAGE_THRESHOLD, F.coalesce("window_pred", F.lit("not_viral"))).otherwise(F.lit("not_viral")))
    d = d.withColumn("label", SC.prediction_label(F.col("will_viral"), F.col("probability"), F.col("time_window")))
    d = SC.boost_and_relabel(d)
    proj, pc = SC.project_views(), SC.pace()
    d = d.select("*", *[c.alias(n) for n, c in proj.items()], *[c.alias(n) for n, c in pc.items()])
    d = d.select("*", SC.momentum(velocity_ratio="velocity_ratio").alias("momentum"),
                 SC.item_confidence(F.col("has_early"), F.col("age_hours")).alias("confidence"),
                 SC.probability_label().alias("probability_label"),
                 SC.warnings(days=X.days_between(fx.AS_OF, "published_at")).alias("warnings"))
    scores = d
    d = shared(spark, sf, "batch-scores", lambda: scores)  # both sides of the join below
    return SC.report_json(d, "video_id", {"prediction": ["probability", "label", "confidence", "time_window"],
                                          "projection": ["views_7d", "views_30d", "projection_confidence"],
                                          "pace": ["velocity_ratio", "vs_avg_pct", "pace_percentile", "momentum"],
                                          "notes": ["warnings"]}).join(d.select("video_id", "probability", "label"),
                                                                       "video_id")


@register("c23_explanations")
def q_c23(spark, sf):
    """C23 explanation rows per owner: level vs p25 / p75 of each feature, template text, top 5 factors."""
    from ..operators import entity_features as EF
    from ..operators.quantiles import quantiles_long
    o = owner_features(spark, sf)
    feats = EF.OWNER_FEATURES
    stats = quantiles_long(o, feats, {"p25": 0.25, "p75": 0.75}, reread=True)
    templates = spark.createDataFrame(
        [(f, lvl, f"{f} is {lvl} relative to peers") for f in feats for lvl in ("high", "low", "medium")],
        "feature string, level string, description string")
    from .training import label_correlations
    weight = label_correlations(o.join(owner_labels(spark, sf), "channel_id"), feats, "is_viral_owner")
    return SC.explanation_rows(o, stats, templates, "channel_id", weight, features=feats)


__all__ = ["C"]


_MATCH_SQL = """
q AS (SELECT s_suppkey AS query_id,
        CASE WHEN s_suppkey % 3 = 0 THEN 'CUSTOMER#' || lpad(CAST(s_suppkey * 5 + 2 AS VARCHAR), 9, '0')
             WHEN s_suppkey % 3 = 1 THEN lpad(CAST(s_suppkey * 5 + 3 AS VARCHAR), 9, '0')
             WHEN s_suppkey % 6 = 2 THEN lpad(CAST(s_suppkey * 11 + 7 AS VARCHAR), 9, '0')
             WHEN s_suppkey % 12 = 5 THEN 'mer#0'
             ELSE 'zz' || CAST(s_suppkey AS VARCHAR) END AS query_text FROM supplier),
j AS (SELECT q.query_id, q.query_text, c.c_custkey AS cand_id, c.c_name AS cand_name,
        CASE WHEN c.c_custkey BETWEEN q.query_id * 5 AND q.query_id * 5 + 4 THEN c.c_custkey - q.query_id * 5 + 1 END AS listed,
        lower(c.c_name) = lower(q.query_text) OR contains(lower(c.c_name), lower(q.query_text)) AS hit
      FROM q CROSS JOIN customer c),
g AS (SELECT query_id, query_text,
        arg_min(cand_id, (coalesce(listed, 6), cand_id)) FILTER (WHERE hit) AS m_id,
        arg_min(cand_name, (coalesce(listed, 6), cand_id)) FILTER (WHERE hit) AS m_name,
        arg_min(cand_id, listed) FILTER (WHERE listed IS NOT NULL) AS f_id,
        arg_min(cand_name, listed) FILTER (WHERE listed IS NOT NULL) AS f_name,
        count(CASE WHEN hit OR listed IS NOT NULL THEN 1 END) AS n
      FROM j GROUP BY query_id, query_text)"""


def _match_inputs(spark, sf):
    s = fx.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    q = s.select(k.alias("query_id"), F.when(k % 3 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad((k * 5 + 2).cast("string"), 9, "0")))
                 .when(k % 3 == 1, F.lpad((k * 5 + 3).cast("string"), 9, "0"))
                 .when(k % 6 == 2, F.lpad((k * 11 + 7).cast("string"), 9, "0")).when(k % 12 == 5, F.lit("mer#0"))
                 .otherwise(F.concat(F.lit("zz"), k.cast("string"))).alias("query_text"))
    # each query's search returns the 5 consecutive customer keys from 5 * id (ranked 1..5); every other customer whose name
    # holds the text follows them
    ranked = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("_i")) \
        .withColumn("cand_id", F.col("query_id") * 5 + F.col("_i")).withColumn("cand_rank", F.col("_i") + 1)
    cust = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("cand_id"), F.col("c_name").alias("cand_name"))
    cand = ranked.join(cust, "cand_id").select("query_id", "cand_id", "cand_name", "cand_rank")
    found = TB.first_containing(q, cust, "query_id", "query_text", "cand_id", "cand_name")
    return q, cand.unionByName(found.withColumn("cand_rank", F.lit(6)))


@register("j12_entity_match", "WITH " + _MATCH_SQL.strip() + """
SELECT query_id, query_text, coalesce(m_id, f_id) AS matched_id,
  CASE WHEN m_id IS NOT NULL THEN m_name ELSE f_name END AS matched_name,
  CASE WHEN m_id IS NOT NULL THEN 'matched' WHEN f_id IS NOT NULL THEN 'first_result' END AS match_kind,
  CASE WHEN n > 0 THEN 'FOUND' ELSE 'NOT_FOUND' END AS status FROM g""")
def q_j12(spark, sf):
    """J12 name -> entity: first ranked candidate equal to or containing the query, else the first one."""
    q, cand = _match_inputs(spark, sf)
    return TB.entity_match(q, cand, "query_id", "query_text", "cand_id", "cand_name", "cand_rank")


@register("j13_upsert_plan", "WITH " + CONTROL_SQL.strip() + """,
cands AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_custkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 0
                 ELSE 1000000 END END AS channel_id, c_name AS channel_name
          FROM customer)
SELECT action, count(*) AS n FROM (
  SELECT CASE WHEN c.channel_id IS NULL THEN 'failed'
              WHEN c.channel_id IN (SELECT channel_id FROM control) THEN 'updated' ELSE 'added' END AS action
  FROM cands c) GROUP BY action""")
def q_j13(spark, sf):
    """J13 candidates vs existing control rows -> added / updated / failed counts."""
    cu = fx.table(spark, sf, "customer")
    k = F.col("c_custkey")
    cands = cu.select(F.when(k % 97 == 0, F.lit(None).cast("bigint"))
                      .otherwise(k + F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1000000)).alias("channel_id"),
                      F.col("c_name").alias("channel_name"))
    plan = TB.upsert_plan(cands, fx.control_table(spark, sf), "channel_id")
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("a30_run_report", "WITH " + RUNLOG_SQL.strip() + """
SELECT r.batch_id, r.channel_id, r.status, r.records_fetched, substr(r.error_msg, 1, 50) AS error_short,
  t.total, t.succeeded, t.succeeded / t.total * 100 AS success_rate
FROM runlog r JOIN (SELECT batch_id, count(*) AS total, CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT)
                    AS succeeded FROM runlog GROUP BY batch_id) t ON r.batch_id = t.batch_id""", ["success_rate"])
def q_a30(spark, sf):
    """A30 batch run report rows: per-entity result with the error cut to 50 chars, plus batch totals."""
    log = fx.run_log(spark, sf)
    tot = C.batch_quality(log).select("batch_id", "total", "succeeded", "success_rate")
    return log.select("batch_id", "channel_id", "status", "records_fetched",
                      F.substring("error_msg", 1, 50).alias("error_short")).join(tot, "batch_id")


@register("a23_row_counts", """
SELECT 'orders' AS table_name, count(*) AS row_count, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM orders
UNION ALL SELECT 'lineitem', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM lineitem
UNION ALL SELECT 'events', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END FROM events
UNION ALL SELECT 'customer_building_negative', count(*), CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END
  FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < -10000""")
def q_a23(spark, sf):
    """A23 row count per table with ok / empty status."""
    from ..operators import quality as Q
    cu = fx.table(spark, sf, "customer")
    return Q.row_counts({"orders": fx.table(spark, sf, "orders"), "lineitem": fx.table(spark, sf, "lineitem"),
                         "events": fx.table(spark, sf, "events"),
                         "customer_building_negative": cu.where((F.col("c_mktsegment") == "BUILDING")
                                                                & (F.col("c_acctbal") < -10000))})


@register("f15_document_text_flags", r"""
SELECT doc_id, lang, CAST(length(coalesce(text, '')) AS INTEGER) AS title_length,
  CASE WHEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' THEN 0
       ELSE CAST(len(string_split_regex(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+')) AS INTEGER)
  END AS title_word_count,
  CAST(regexp_matches(coalesce(text, ''), '\d') AS INTEGER) AS has_number,
  CAST(contains(coalesce(text, ''), '?') AS INTEGER) AS has_question,
  CAST(contains(coalesce(text, ''), '!') AS INTEGER) AS has_exclamation,
  CAST(regexp_matches(coalesce(text, ''), '[\x{1F300}-\x{1FFFF}]') AS INTEGER) AS has_emoji,
  CAST(regexp_matches(coalesce(text, ''), '(^|[^\p{L}\p{N}_])[A-Z]{3,}($|[^\p{L}\p{N}_])') AS INTEGER) AS has_caps_word,
  contains(lower(text), lower(lang)) AS mentions_lang,
  substr(text, 1, 200) AS preview
FROM documents""")
def q_f15(spark, sf):
    """F15–F17 over whole document texts: length, whitespace words, digit / ? / ! / emoji / ALL-CAPS flags,
    case-insensitive containment and truncation. Word boundaries are Unicode-aware (as in the reference's
    regex engine); the oracle spells the boundary out with Unicode letter / digit classes."""
    d = fx.table(spark, sf, "documents")
    fl = X.text_flags("text")
    return d.select("doc_id", "lang", *[c.alias(n) for n, c in fl.items()],
                    F.lower(F.col("text")).contains(F.lower(F.col("lang"))).alias("mentions_lang"),
                    F.substring("text", 1, 200).alias("preview"))


# --- operators that no other query reaches --------------------------------------------------------

@register("t03_control_listing", "WITH " + CONTROL_SQL.strip() + "SELECT * FROM control")
def q_t03(spark, sf):
    """T03 whole control table, priority desc, next run, key."""
    return C.listing(fx.control_table(spark, sf))


@register("j11_first_row_lookup", """
SELECT o.o_orderkey AS order_key, f.s.d AS l_shipdate, f.s.n AS l_linenumber
FROM orders o LEFT JOIN (SELECT l_orderkey, min({'d': l_shipdate, 'n': l_linenumber}) AS s FROM lineitem
                         WHERE l_linenumber > 2 GROUP BY 1) f ON f.l_orderkey = o.o_orderkey""")
def q_j11(spark, sf):
    """J11 every order with its first shipped line after the second, looked up without fan-out (orders without one stay)."""
    lines = fx.table(spark, sf, "lineitem").where(F.col("l_linenumber") > 2).withColumnRenamed("l_orderkey", "order_key")
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"))
    cols = ["l_shipdate", "l_linenumber"]
    return TB.lookup_first(orders, lines, "order_key", cols, cols)


@register("i02_additive_upsert", """
SELECT CAST(ts AS DATE) AS date, CAST(sum(CASE WHEN event_type = 'view' THEN 10 ELSE 5 END) AS BIGINT) AS quota_used,
  count(*) AS calls FROM events GROUP BY 1""")
def q_i02(spark, sf):
    """I02 daily usage of views, with the other events' usage added row by row (used = used + new)."""
    ev = fx.table(spark, sf, "events").select(F.to_date("ts").alias("date"), (F.col("event_type") == "view").alias("_view"))
    ev = ev.withColumn("calls", F.lit(1).cast("bigint"))
    used = ev.where("_view").groupBy("date").agg((F.count(F.lit(1)) * 10).alias("quota_used"), F.count(F.lit(1)).alias("calls"))
    new = ev.where("_view is not true").withColumn("quota_used", F.lit(5).cast("bigint"))
    return TB.additive_upsert(used, new, ["date"], ["quota_used", "calls"])


@register("p16_display_rows", """
SELECT trim(c_name) AS id, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE CAST(c_custkey AS BIGINT) * 3 END AS subscribers
FROM customer WHERE c_custkey % 10 <> 0""")
def q_p16(spark, sf):
    """P16 display rows: empty ids dropped, counts in text made numbers (0 where they are none), sorted by count."""
    k = F.col("c_custkey")
    shown = fx.table(spark, sf, "customer").select(
        F.when(k % 20 == 0, F.lit("  ")).when(k % 10 != 0, F.col("c_name")).alias("id"),
        F.when(k % 7 == 0, F.lit("n/a")).otherwise((k * 3).cast("string")).alias("subscribers"))
    return IO.clean_for_display(shown, "id", ["subscribers"], "subscribers")


@register("f19_value_texts", with_ctes("summary") + """,
v AS (SELECT channel_id, 'total_views' AS feature, CAST(total_views AS DOUBLE) AS value FROM summary
      UNION ALL SELECT channel_id, 'like_ratio', total_views / 7000000000.0 FROM summary
      UNION ALL SELECT channel_id, 'view_trend', CASE WHEN channel_id % 4 = 0 THEN 0.0 ELSE (channel_id % 100) / 8.0 END FROM summary
      UNION ALL SELECT channel_id, 'size_tier', CAST(channel_id % 9 AS DOUBLE) FROM summary
      UNION ALL SELECT channel_id, 'consistency', channel_id / 16.0 FROM summary)
SELECT channel_id, feature, CASE WHEN feature = 'like_ratio' THEN printf('%.2f%%', value * 100)
  WHEN feature = 'total_views' AND value >= 1000000 THEN printf('%.1fM', value / 1000000)
  WHEN feature = 'total_views' AND value > 1000 THEN printf('%.0fK', value / 1000)
  WHEN feature = 'size_tier' THEN format('{:,}', CAST(pow(10, value) AS BIGINT)) || ' subscribers'
  WHEN feature = 'view_trend' AND value = 0 THEN 'N/A' WHEN feature = 'view_trend' THEN printf('%.2fx', value)
  ELSE printf('%.3f', value) END AS shown FROM v""")
def q_f19(spark, sf):
    """F19 values as text by the feature's kind (percent, M / K, subscribers, factor, plain)."""
    s = base(spark, sf)["channel_summary"]
    k = F.col("channel_id")
    values = {"total_views": F.col("total_views").cast("double"), "like_ratio": F.col("total_views") / 7000000000.0,
              "view_trend": F.when(k % 4 == 0, 0.0).otherwise((k % 100) / 8.0), "size_tier": (k % 9).cast("double"),
              "consistency": k / 16.0}
    long = s.select("channel_id", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value"))
                                                       for n, c in values.items()])).alias("_v")).select("channel_id", "_v.*")
    return long.select("channel_id", "feature", X.feature_value_text("feature", "value").alias("shown"))


# --- I03 log append, S10 / I01 layers -------------------------------------------------------------

@register("i03_run_log_append", "WITH " + RUNLOG_SQL.strip() + """,
old AS (SELECT * FROM runlog WHERE crawl_ts < TIMESTAMP '2024-01-25'),
runs AS (SELECT * REPLACE (CASE WHEN status = 'success' THEN records_fetched END AS records_fetched,
                           CASE WHEN status = 'success' THEN execution_time_seconds END AS execution_time_seconds)
         FROM runlog WHERE crawl_ts >= TIMESTAMP '2024-01-25')
SELECT * FROM old
UNION ALL
SELECT * REPLACE ((SELECT max(log_id) FROM old) + row_number() OVER (
  ORDER BY crawl_ts, channel_id, records_fetched NULLS FIRST, status, error_msg NULLS FIRST, execution_time_seconds NULLS FIRST) AS log_id)
FROM runs""", ["execution_time_seconds"])
def q_i03_log(spark, sf):
    """I03 second half: the runs since 25 January appended to the log of the runs before."""
    log = fx.run_log(spark, sf)
    cut = F.lit("2024-01-25").cast("timestamp")
    return C.append_run_log(log.where(F.col("crawl_ts") < cut), log.where(F.col("crawl_ts") >= cut).drop("log_id"))


def _order_layer(spark, sf):
    """The orders as a mart partitioned by month, in a folder that goes when the application ends; (its path, the orders)."""
    orders = fx.table(spark, sf, "orders")
    root = f"{scratch_path(spark, 'order-layer')}-{uuid.uuid4().hex}"
    delete_at_exit(spark, root)
    IO.materialize_layer(orders, root, "mart", "orders", "o_orderdate", cluster_by=["o_orderkey"])
    return f"{IO.layer_path(root, 'mart')}/orders", orders


@register("s10_layer_date_scan", """
SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-10' AND o_orderdate < TIMESTAMP '1996-06-05'""", ["o_totalprice"])
def q_s10(spark, sf):
    """S10 a mart partitioned by month, read by a range of dates: only the months that overlap it are listed."""
    path, _ = _order_layer(spark, sf)
    return LY.scan_dates(spark, path, "o_orderdate", datetime(1996, 3, 10), datetime(1996, 6, 5))


@register("i01_layer_merge", """
WITH src AS (
  SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000000000 ELSE 0 END AS o_orderkey, o_custkey, 'M' AS o_orderstatus,
    o_totalprice + 1 AS o_totalprice, o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS o_orderdate, o_orderpriority
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-04-01')
SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src) UNION ALL SELECT * FROM src""", ["o_totalprice"])
def q_i01_layer(spark, sf):
    """I01 on that mart: the orders of a quarter come again, a third of them as new keys, the others changed and up to 59 days later;
    only the months that lose or gain a row are rewritten."""
    path, orders = _order_layer(spark, sf)
    k, when = F.col("o_orderkey"), F.col("o_orderdate")
    src = orders.where((when >= F.lit("1998-01-01").cast("timestamp")) & (when < F.lit("1998-04-01").cast("timestamp"))).select(
        (k + F.when(k % 3 == 0, F.lit(10 ** 9)).otherwise(F.lit(0))).alias("o_orderkey"), "o_custkey", F.lit("M").alias("o_orderstatus"),
        (F.col("o_totalprice") + 1).alias("o_totalprice"), (when + F.make_dt_interval(days=(k % 60).cast("int"))).alias("o_orderdate"),
        "o_orderpriority")
    LY.merge_layer(spark, path, src, ["o_orderkey"], "o_orderdate")
    return spark.read.parquet(path).drop(LY.PART)
