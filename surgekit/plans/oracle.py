"""DuckDB SQL for the oracle check: the fixture adapter and the marts written independently in SQL.

DuckDB rules applied throughout: ``a / nullif(b, 0)`` (DuckDB divides by zero to inf),
``dayofweek + 1`` (DuckDB counts Sunday as 0), integer sums cast back to BIGINT (DuckDB widens to
HUGEINT), integer date parts cast to INTEGER (Spark returns INT).
"""

from __future__ import annotations

AS_OF = "DATE '2001-08-02'"
CRAWLED = "TIMESTAMP '2001-08-02 06:00:00'"


def lenient_duration(x: str) -> str:
    def piece(p, mult):
        m = f" * {mult}" if mult != 1 else ""
        return f"coalesce(TRY_CAST(nullif(regexp_extract(coalesce({x}, ''), '{p}', 1), '') AS BIGINT), 0){m}"
    return "(" + " + ".join([piece(r"(\d+)D", 86400), piece(r"T(\d+)H", 3600), piece(r"(\d+)M", 60),
                             piece(r"(\d+)S$", 1)]) + ")"


ITEMS = r"""
li AS (
  SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS _q, count(l_orderkey) AS _n
  FROM lineitem GROUP BY l_orderkey),
o2 AS (SELECT *, (o_orderkey * 7919) % 5400 AS _s FROM orders),
items AS (
  SELECT o_orderkey AS video_id, o_custkey AS channel_id,
    concat_ws(' ', o_orderpriority, 'order', CAST(o_orderkey AS VARCHAR),
              CASE WHEN o_orderkey % 7 = 0 THEN '?' END, CASE WHEN o_orderkey % 11 = 0 THEN '!' END) AS title,
    o_orderstatus AS description,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL
         ELSE '["' || o_orderstatus || '","' || o_orderpriority || '"]' END AS tags,
    substr(o_orderpriority, 1, 1) AS category_id,
    'en' AS default_language,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS published_at,
    CAST(floor(o_totalprice) AS BIGINT) AS view_count,
    CAST(coalesce(_q, 0) AS BIGINT) AS like_count,
    CAST(coalesce(_n, 0) AS BIGINT) AS comment_count,
    CASE WHEN o_orderkey % 101 = 0 THEN 'P1DT' ELSE 'PT' END
      || CASE WHEN _s // 3600 > 0 THEN CAST(_s // 3600 AS VARCHAR) || 'H' ELSE '' END
      || CASE WHEN (_s % 3600) // 60 > 0 THEN CAST((_s % 3600) // 60 AS VARCHAR) || 'M' ELSE '' END
      || CASE WHEN _s % 60 > 0 OR _s = 0 THEN CAST(_s % 60 AS VARCHAR) || 'S' ELSE '' END AS duration_iso8601,
    o_orderkey % 3 = 0 AS has_caption,
    CASE WHEN o_orderkey % 4 = 0 THEN 'sd' ELSE 'hd' END AS definition,
    'public' AS privacy_status,
    o_orderkey % 5 <> 0 AS is_embeddable,
    o_orderkey % 10 = 0 AS is_made_for_kids,
    TIMESTAMP '2001-08-02 06:00:00' AS crawled_at
  FROM o2 LEFT JOIN li ON o_orderkey = l_orderkey)"""

OWNERS = r"""
owners AS (
  SELECT c_custkey AS channel_id, c_name AS channel_name, n_name AS country_code,
    CAST(floor(greatest(c_acctbal, 0.0)) AS BIGINT) AS subscriber_count,
    CAST(DATE '1995-01-01' - CAST(c_custkey % 1000 AS INTEGER) AS TIMESTAMP) AS channel_created_at,
    c_mktsegment AS segment, TIMESTAMP '2001-08-02 06:00:00' AS crawled_at
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

ENHANCED = f"""
enhanced AS (
  SELECT v.*, c.channel_name, c.subscriber_count AS channel_subscribers, c.country_code, c.channel_created_at,
    {lenient_duration('v.duration_iso8601')} AS duration_seconds,
    CAST(v.published_at AS DATE) AS published_date,
    CAST(year(v.published_at) AS INTEGER) AS published_year,
    CAST(month(v.published_at) AS INTEGER) AS published_month,
    CAST(dayofweek(v.published_at) + 1 AS INTEGER) AS published_dayofweek,
    CAST(hour(v.published_at) AS INTEGER) AS published_hour,
    CAST(date_diff('day', CAST(v.published_at AS DATE), {AS_OF}) AS INTEGER) AS days_since_published,
    CASE WHEN {lenient_duration('v.duration_iso8601')} <= 60 THEN 'shorts'
         WHEN {lenient_duration('v.duration_iso8601')} <= 600 THEN 'short'
         WHEN {lenient_duration('v.duration_iso8601')} <= 1800 THEN 'medium' ELSE 'long' END AS video_length_category
  FROM items v LEFT JOIN owners c ON v.channel_id = c.channel_id)"""

METRICS = """
    CASE WHEN view_count > 0 THEN least(like_count / view_count * 100, 100.0) ELSE 0.0 END AS like_rate_pct,
    CASE WHEN view_count > 0 THEN least(comment_count / view_count * 100, 100.0) ELSE 0.0 END AS comment_rate_pct,
    CASE WHEN view_count > 0 THEN (like_count + comment_count * 2) / view_count * 100 ELSE 0.0 END AS engagement_score,
    view_count / nullif(days_since_published, 0) AS avg_views_per_day,
    CASE WHEN view_count = 0 THEN 'low'
         WHEN like_count / view_count >= 0.05 THEN 'high'
         WHEN like_count / view_count >= 0.02 THEN 'medium' ELSE 'low' END AS engagement_level,
    CASE WHEN view_count / nullif(days_since_published, 0) > channel_subscribers * 0.1 THEN true
         ELSE false END AS is_potentially_viral"""

ENGAGEMENT = f"""
engagement AS (
  SELECT video_id, channel_id, title, published_at, published_date, view_count, like_count, comment_count,
    days_since_published, video_length_category, channel_name, channel_subscribers, country_code,
    {METRICS}
  FROM enhanced WHERE days_since_published > 0)"""

FACT = """
fact AS (
  SELECT v.video_id, v.channel_id, v.category_id, v.title, v.published_at, v.published_date, v.published_year,
    v.published_month, v.channel_name, v.country_code, v.video_length_category, v.duration_seconds,
    v.view_count, v.like_count, v.comment_count, m.like_rate_pct, m.comment_rate_pct, m.engagement_score,
    m.avg_views_per_day, m.engagement_level, m.is_potentially_viral,
    v.has_caption, v.is_embeddable, v.is_made_for_kids, v.definition, v.crawled_at
  FROM enhanced v LEFT JOIN engagement m ON v.video_id = m.video_id)"""

SUMMARY = """
summary AS (
  SELECT channel_id,
    max(channel_name) AS channel_name, max(country_code) AS country_code,
    max(channel_subscribers) AS subscriber_count, max(channel_created_at) AS channel_created_at,
    count(DISTINCT video_id) AS total_videos_crawled,
    CAST(sum(view_count) AS BIGINT) AS total_views, avg(view_count) AS avg_views_per_video,
    CAST(sum(like_count) AS BIGINT) AS total_likes, CAST(sum(comment_count) AS BIGINT) AS total_comments,
    avg(like_count / nullif(view_count, 0)) * 100 AS avg_like_rate_pct,
    avg(comment_count / nullif(view_count, 0)) * 100 AS avg_comment_rate_pct,
    avg(duration_seconds) AS avg_video_duration_seconds,
    CAST(max(published_at) AS DATE) AS latest_video_date,
    CAST(min(published_at) AS DATE) AS earliest_video_date,
    date_diff('day', CAST(min(published_at) AS DATE), CAST(max(published_at) AS DATE))
      / nullif(count(DISTINCT video_id) - 1, 0) AS avg_days_between_uploads,
    max(crawled_at) AS last_crawled_at
  FROM enhanced GROUP BY channel_id)"""

DIM = """
dim AS (
  SELECT channel_id, channel_name, country_code, subscriber_count, channel_created_at, total_videos_crawled,
    total_views, avg_views_per_video, total_likes, total_comments, avg_like_rate_pct, avg_comment_rate_pct,
    avg_video_duration_seconds, latest_video_date, earliest_video_date,
    CAST(date_diff('day', earliest_video_date, latest_video_date) AS INTEGER) AS channel_active_days,
    avg_days_between_uploads,
    total_views / nullif(subscriber_count, 0) AS views_per_subscriber,
    total_videos_crawled / nullif(date_diff('day', earliest_video_date, latest_video_date), 0) * 7
      AS videos_per_week,
    last_crawled_at
  FROM summary)"""

DAILY = """
daily AS (
  SELECT md5(concat_ws('-', coalesce(CAST(metric_date AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                       coalesce(CAST(channel_id AS VARCHAR), '_dbt_utils_surrogate_key_null_'))) AS date_channel_key,
    *
  FROM (
    SELECT CAST(published_at AS DATE) AS metric_date, channel_id,
      max(channel_name) AS channel_name, max(country_code) AS country_code,
      count(DISTINCT video_id) AS videos_published,
      CAST(sum(view_count) AS BIGINT) AS total_views, CAST(sum(like_count) AS BIGINT) AS total_likes,
      CAST(sum(comment_count) AS BIGINT) AS total_comments,
      avg(engagement_score) AS avg_engagement_score, avg(like_rate_pct) AS avg_like_rate_pct,
      max(view_count) AS max_video_views
    FROM fact GROUP BY 1, 2))"""

# name -> CTE text, in dependency order
CTES = {"items": ITEMS, "owners": OWNERS, "enhanced": ENHANCED, "engagement": ENGAGEMENT, "fact": FACT,
        "summary": SUMMARY, "dim": DIM, "daily": DAILY}
_DEPS = {"items": [], "owners": [], "enhanced": ["items", "owners"], "engagement": ["enhanced"],
         "fact": ["enhanced", "engagement"], "summary": ["enhanced"], "dim": ["summary"], "daily": ["fact"]}


def with_ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named base relations (and their dependencies) plus extra CTEs."""
    order: list[str] = []

    def visit(n):
        for d in _DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTES[n].strip() for n in order]
    if extra.strip():
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(sql: str, cols: list[str], digits: int = 6) -> str:
    """Round the listed DOUBLE columns the way Spark's ``round`` does on the Spark side: HALF_UP applied to
    the double's shortest decimal string (Spark goes through ``BigDecimal.valueOf``), so ties at the 7th
    digit agree; NaN / infinity and very large values pass through DuckDB's own round."""
    if not cols:
        return sql
    rep = ", ".join(
        f"CASE WHEN isnan({c}) OR isinf({c}) OR abs({c}) >= 1e19 THEN round({c}, {digits}) "
        f"ELSE CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE) END AS {c}"
        for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"
