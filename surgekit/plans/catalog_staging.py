"""Catalog entries for JSON staging (S03, P01–P07, F01/F02) and the end-to-end raw -> mart plan.

The oracle builds its own raw JSON with DuckDB's ``json_object`` and reads it back with
``json_extract_string``; text formats differ from Spark's ``to_json`` but the flattened values must not.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import envelopes as EV
from ..sources import fixtures as fx
from . import marts
from .catalog import register
from .oracle import CTES, DAILY, ENHANCED, ENGAGEMENT, FACT, ITEMS, OWNERS

ISO = "'%Y-%m-%dT%H:%M:%SZ'"

RAW_SQL = f"""
rv AS (
  SELECT CAST(video_id AS VARCHAR) AS id,
    json_object(
      'snippet', json_object('channelId', CAST(channel_id AS VARCHAR), 'title', title, 'description', description,
                             'tags', CASE WHEN tags IS NULL THEN NULL ELSE json(tags) END, 'categoryId', category_id,
                             'defaultLanguage', CASE WHEN video_id % 5 <> 0 THEN default_language END,
                             'defaultAudioLanguage', CASE WHEN video_id % 3 = 0 THEN NULL WHEN video_id % 2 = 0 THEN 'de' ELSE 'fr' END,
                              'publishedAt', strftime(published_at, {ISO})),
      'statistics', json_object('viewCount', CAST(view_count AS VARCHAR),
                                'likeCount', CASE WHEN video_id % 13 <> 0 THEN CAST(like_count AS VARCHAR) END,
                                'commentCount', CASE WHEN video_id % 17 <> 0 THEN CAST(comment_count AS VARCHAR) END),
      'contentDetails', json_object('duration', CASE WHEN video_id % 53 <> 0 THEN duration_iso8601 END,
                                    'caption', CASE WHEN has_caption THEN 'true' ELSE 'false' END,
                                    'definition', definition),
      'status', json_object('privacyStatus', CASE WHEN video_id % 37 = 0 THEN 'private'
                                                  WHEN video_id % 41 = 0 THEN NULL ELSE 'public' END,
                            'embeddable', is_embeddable, 'madeForKids', is_made_for_kids)) AS raw,
    crawled_at AS ingestion_time
  FROM items),
rc AS (
  SELECT CAST(channel_id AS VARCHAR) AS id,
    json_object('items', CASE WHEN channel_id % 29 = 0 THEN json('[]') ELSE json_array(json_object(
      'snippet', json_object('title', channel_name, 'description', segment,
                             'publishedAt', strftime(channel_created_at, {ISO}), 'country', country_code,
                             'customUrl', '@c' || CAST(channel_id AS VARCHAR)),
      'statistics', json_object('subscriberCount', CAST(subscriber_count AS VARCHAR),
                                'viewCount', CAST(subscriber_count * 10 AS VARCHAR),
                                'videoCount', CAST(channel_id % 50 AS VARCHAR),
                                'hiddenSubscriberCount', CASE WHEN subscriber_count = 0 THEN 'true' ELSE 'false' END),
      'contentDetails', json_object('relatedPlaylists', json_object('uploads', 'UU' || CAST(channel_id AS VARCHAR))),
      'topicDetails', json_object('topicIds', json_array(segment, country_code)))) END) AS raw,
    crawled_at AS ingestion_time
  FROM owners),
pl_n AS (SELECT o_custkey AS channel_id, count(*) AS n FROM orders GROUP BY o_custkey),
rp AS (
  SELECT 'PL' || CAST(o.channel_id AS VARCHAR) AS id, CAST(o.channel_id AS VARCHAR) AS channel_id,
    json_object('snippet', json_object('title', channel_name || ' uploads', 'description', segment,
                                       'publishedAt', strftime(channel_created_at, {ISO})),
                'contentDetails', json_object('itemCount', CAST(coalesce(n, 0) AS VARCHAR)),
                'status', json_object('privacyStatus', CASE WHEN o.channel_id % 4 = 0 THEN 'private'
                                                            ELSE 'public' END)) AS raw,
    crawled_at AS ingestion_time
  FROM owners o LEFT JOIN pl_n p ON o.channel_id = p.channel_id)"""

STG_SQL = f"""
valid_ch AS (SELECT id AS channel_id FROM rc WHERE json_array_length(json_extract(raw, '$.items')) > 0),
stg_channels AS (
  SELECT id AS channel_id, ingestion_time AS crawled_at,
    json_extract_string(raw, '$.items[0].snippet.title') AS channel_name,
    json_extract_string(raw, '$.items[0].snippet.description') AS description,
    CAST(strptime(json_extract_string(raw, '$.items[0].snippet.publishedAt'), {ISO}) AS TIMESTAMP) AS channel_created_at,
    json_extract_string(raw, '$.items[0].snippet.country') AS country_code,
    json_extract_string(raw, '$.items[0].snippet.customUrl') AS custom_url,
    CAST(json_extract_string(raw, '$.items[0].statistics.subscriberCount') AS BIGINT) AS subscriber_count,
    CAST(json_extract_string(raw, '$.items[0].statistics.viewCount') AS BIGINT) AS total_view_count,
    CAST(json_extract_string(raw, '$.items[0].statistics.videoCount') AS BIGINT) AS video_count,
    CAST(json_extract_string(raw, '$.items[0].statistics.hiddenSubscriberCount') AS BOOLEAN) AS has_hidden_subscribers,
    json_extract_string(raw, '$.items[0].contentDetails.relatedPlaylists.uploads') AS uploads_playlist_id,
    nullif(json_extract(raw, '$.items[0].topicDetails.topicIds')::VARCHAR, 'null') AS topic_ids
  FROM rc WHERE json_array_length(json_extract(raw, '$.items')) > 0),
stg_flat AS (
  SELECT id AS video_id, ingestion_time AS crawled_at,
    json_extract_string(raw, '$.snippet.channelId') AS channel_id,
    json_extract_string(raw, '$.snippet.title') AS title,
    json_extract_string(raw, '$.snippet.description') AS description,
    nullif(json_extract(raw, '$.snippet.tags')::VARCHAR, 'null') AS tags,
    json_extract_string(raw, '$.snippet.categoryId') AS category_id,
    json_extract_string(raw, '$.snippet.defaultLanguage') AS default_language,
    CAST(strptime(json_extract_string(raw, '$.snippet.publishedAt'), {ISO}) AS TIMESTAMP) AS published_at,
    CAST(json_extract_string(raw, '$.statistics.viewCount') AS BIGINT) AS view_count,
    coalesce(CAST(json_extract_string(raw, '$.statistics.likeCount') AS BIGINT), 0) AS like_count,
    coalesce(CAST(json_extract_string(raw, '$.statistics.commentCount') AS BIGINT), 0) AS comment_count,
    json_extract_string(raw, '$.contentDetails.duration') AS duration_iso8601,
    CAST(json_extract_string(raw, '$.contentDetails.caption') AS BOOLEAN) AS has_caption,
    json_extract_string(raw, '$.contentDetails.definition') AS definition,
    coalesce(json_extract_string(raw, '$.status.privacyStatus'), 'public') AS privacy_status,
    CAST(json_extract_string(raw, '$.status.embeddable') AS BOOLEAN) AS is_embeddable,
    CAST(json_extract_string(raw, '$.status.madeForKids') AS BOOLEAN) AS is_made_for_kids
  FROM rv),
stg_videos AS (
  SELECT * FROM stg_flat
  WHERE privacy_status = 'public' AND duration_iso8601 IS NOT NULL
    AND channel_id IN (SELECT channel_id FROM valid_ch)),
stg_playlists AS (
  SELECT id AS playlist_id, channel_id, ingestion_time AS crawled_at,
    json_extract_string(raw, '$.snippet.title') AS playlist_name,
    json_extract_string(raw, '$.snippet.description') AS description,
    CAST(strptime(json_extract_string(raw, '$.snippet.publishedAt'), {ISO}) AS TIMESTAMP) AS created_at,
    CAST(json_extract_string(raw, '$.contentDetails.itemCount') AS BIGINT) AS item_count,
    json_extract_string(raw, '$.status.privacyStatus') AS privacy_status
  FROM rp WHERE json_extract_string(raw, '$.status.privacyStatus') = 'public'
    AND channel_id IN (SELECT channel_id FROM valid_ch))"""

BASE = "WITH " + ",".join([ITEMS.strip(), OWNERS.strip(), RAW_SQL.strip(), STG_SQL.strip()]) + "\n"


def _raw(spark, sf):
    return EV.raw_videos(spark, sf), EV.raw_channels(spark, sf)


@register("p01_stg_channels", BASE + "SELECT * FROM stg_channels")
def q_p01(spark, sf):
    """P01 + P04 flatten channel responses (single from_json parse), non-empty item lists only."""
    return EV.stg_channels(EV.raw_channels(spark, sf))


@register("p02_stg_videos", BASE + "SELECT * FROM stg_videos")
def q_p02(spark, sf):
    """P02 + P05 + P06 + J02 flatten item records, public / has duration / valid channel."""
    rv, rc = _raw(spark, sf)
    return EV.stg_videos(rv, rc)


@register("p03_stg_playlists", BASE + "SELECT * FROM stg_playlists")
def q_p03(spark, sf):
    """P03 flatten playlists, strict public filter, valid channel."""
    return EV.stg_playlists(EV.raw_playlists(spark, sf), EV.raw_channels(spark, sf))


@register("f01_event_props", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  json_extract_string(props, '$.missing') AS missing FROM events""")
def q_f01(spark, sf):
    """F01 JSON_VALUE over events.props: present and absent paths."""
    ev = fx.table(spark, sf, "events")
    return EV.extract_json(ev, "props", {"k": ("$.k", "bigint"), "missing": ("$.missing", "value")},
                           keep=["event_id"])


@register("p19_stg_comments", f"""
WITH rcm AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS video_id,
    CAST(conv_id % 50 AS VARCHAR) AS channel_id,
    json_object('snippet', json_object('topLevelComment', json_object('snippet', json_object(
        'authorDisplayName', role, 'textDisplay', text, 'likeCount', turn * 3,
        'publishedAt', strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id % 1000 AS INTEGER))
                                + to_minutes(CAST(turn AS INTEGER)), {ISO}))),
      'totalReplyCount', turn % 4)) AS raw,
    TIMESTAMP '2001-08-02 06:00:00' AS ingestion_time
  FROM conversations)
SELECT id AS comment_id, video_id, channel_id, ingestion_time AS crawled_at,
  json_extract_string(raw, '$.snippet.topLevelComment.snippet.authorDisplayName') AS author,
  json_extract_string(raw, '$.snippet.topLevelComment.snippet.textDisplay') AS text,
  CAST(json_extract_string(raw, '$.snippet.topLevelComment.snippet.likeCount') AS BIGINT) AS like_count,
  CAST(strptime(json_extract_string(raw, '$.snippet.topLevelComment.snippet.publishedAt'), {ISO}) AS TIMESTAMP)
    AS published_at,
  CAST(json_extract_string(raw, '$.snippet.totalReplyCount') AS BIGINT) AS reply_count
FROM rcm""")
def q_p19(spark, sf):
    """P19 + S03: comment-thread envelopes built from conversations and flattened (whole texts)."""
    return EV.stg_comments(EV.raw_comments(spark, sf))


# the whole staging -> intermediate -> mart chain starting from raw JSON envelopes
_RAW_MARTS = (BASE.rstrip() + ",\n" + "items2 AS (SELECT * FROM stg_videos), owners2 AS (SELECT * FROM stg_channels),\n"
              + ",\n".join(t.strip().replace("FROM items v", "FROM items2 v").replace("JOIN owners c", "JOIN owners2 c")
                           for t in (ENHANCED, ENGAGEMENT, FACT, DAILY)) + "\n")
assert "summary" in CTES


@register("a03_daily_rollup_from_raw", _RAW_MARTS + "SELECT * FROM daily",
          ["avg_engagement_score", "avg_like_rate_pct"])
def q_a03_raw(spark, sf):
    """Flagship end to end: raw JSON envelopes -> staging (P01/P02) -> C01 -> C03 -> A03 daily rollup."""
    rv, rc = _raw(spark, sf)
    m = marts.build_marts(EV.stg_videos(rv, rc), EV.stg_channels(rc), fx.AS_OF)
    return m["daily"]


@register("c03_fact_from_raw", _RAW_MARTS + "SELECT * FROM fact",
          ["like_rate_pct", "comment_rate_pct", "engagement_score", "avg_views_per_day"])
def q_c03_raw(spark, sf):
    """C03 fact table built from raw JSON envelopes."""
    rv, rc = _raw(spark, sf)
    return marts.build_marts(EV.stg_videos(rv, rc), EV.stg_channels(rc), fx.AS_OF)["fact"]


__all__ = ["F"]
