"""Column expressions.

Every function takes and returns ``pyspark.sql.Column`` so it stays inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values that must equal the reference's for identical results
# ---------------------------------------------------------------------------
# surrogate-key null token and separator used by the warehouse key macro
SURROGATE_NULL_TOKEN = "_dbt_utils_surrogate_key_null_"
SURROGATE_SEPARATOR = "-"
# video length classes: upper bounds in seconds -> label, last label is the open bucket
LENGTH_EDGES = (60, 600, 1800)
LENGTH_LABELS = ("shorts", "short", "medium", "long")
# engagement level by like/view ratio
ENGAGEMENT_HIGH = 0.05
ENGAGEMENT_MEDIUM = 0.02
# ordinal map for engagement level
LEVEL_CODES = {"high": 2, "medium": 1, "low": 0}


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- F07 / F08 null and safe arithmetic ------------------------------------------------

def safe_div(a, b, default=None) -> Column:
    """SAFE_DIVIDE: NULL (or ``default``) when b is 0 or NULL; never raises under ANSI."""
    q = F.try_divide(col_(a).cast("double"), col_(b).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(default))


def nullif(c, v) -> Column:
    c = col_(c)
    return F.when(c == F.lit(v), F.lit(None)).otherwise(c)


def coerce(c, dtype: str, default=None) -> Column:
    """coerce-or-default (``pd.to_numeric(errors='coerce').fillna(d)``)."""
    x = F.expr(f"try_cast({c} as {dtype})") if isinstance(c, str) else c.try_cast(dtype)
    return x if default is None else F.coalesce(x, F.lit(default))


def safe_corr(a, b) -> Column:
    """Pearson r that is NULL (not an ANSI divide-by-zero error) for constant or single-row input."""
    x, y = col_(a).cast("double"), col_(b).cast("double")
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


# --- F01 / F02 JSON ------------------------------------------------------------------

def scalar_text(v) -> Column:
    """JSON_VALUE of a VARIANT: its text if it is a scalar, NULL for objects, arrays and JSON null."""
    c = col_(v)
    return F.when(F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)"), F.lit(None)).otherwise(c.cast("string"))


# --- F03 / F04 ISO-8601 durations ------------------------------------------------------

def _piece(s: Column, pattern: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).try_cast("bigint"), F.lit(0))


def iso_duration_lenient(c) -> Column:
    """Regex-piece dialect: days, ``T..H``, ``..M``, ``..S$``; a missing piece counts 0, NULL -> 0."""
    s = F.coalesce(col_(c), F.lit(""))
    return (_piece(s, r"(\d+)D") * 86400 + _piece(s, r"T(\d+)H") * 3600
            + _piece(s, r"(\d+)M") * 60 + _piece(s, r"(\d+)S$"))


_STRICT = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def iso_duration_strict(c) -> Column:
    """Full-match dialect: anything not matching the whole pattern (or empty/NULL) -> 0."""
    s = F.trim(F.coalesce(col_(c), F.lit("")))

    def g(i):
        return F.coalesce(F.nullif(F.regexp_extract(s, _STRICT, i), F.lit("")).try_cast("bigint"), F.lit(0))

    total = g(1) * 86400 + g(2) * 3600 + g(3) * 60 + g(4)
    return F.when((s != "") & s.rlike(_STRICT), total).otherwise(F.lit(0).cast("bigint"))


# --- F11 / F12 / F13 / F14 dates -----------------------------------------------------

def date_parts(ts) -> dict[str, Column]:
    t = col_(ts)
    return {
        "published_date": F.to_date(t),
        "published_year": F.year(t),
        "published_month": F.month(t),
        "published_dayofweek": F.dayofweek(t),  # 1 = Sunday
        "published_hour": F.hour(t),
    }


def days_between(as_of, ts) -> Column:
    """date_diff(as_of, date(ts), day)."""
    return F.datediff(F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of, F.to_date(col_(ts)))


def fractional_days(as_of, ts) -> Column:
    """Elapsed days as a double from microsecond epochs."""
    end = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return (F.unix_micros(end) - F.unix_micros(col_(ts).cast("timestamp"))) / F.lit(86400e6)


def human_age(as_of, ts) -> Column:
    """'d days h hours' when at least a day, else 'h hours'."""
    secs = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(col_(ts).cast("timestamp"))
    days = F.floor(secs / 86400)
    hours = F.floor((secs - days * 86400) / 3600)
    return F.when(days > 0, F.format_string("%d days %d hours", days, hours)).otherwise(
        F.format_string("%d hours", hours))


# --- F15 / F16 / F17 strings -----------------------------------------------------------

def word_count(c) -> Column:
    """Whitespace word count, 0 for empty/NULL."""
    t = F.regexp_replace(F.coalesce(col_(c), F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def text_flags(c) -> dict[str, Column]:
    t = F.coalesce(col_(c), F.lit(""))
    return {
        "title_length": F.length(t),
        "title_word_count": word_count(t),
        "has_number": t.rlike(r"\d").cast("int"),
        "has_question": t.contains("?").cast("int"),
        "has_exclamation": t.contains("!").cast("int"),
        "has_emoji": t.rlike(r"[\x{1F300}-\x{1FFFF}]").cast("int"),
        "has_caps_word": t.rlike(r"\b[A-Z]{3,}\b").cast("int"),
    }


def comma_item_count(c) -> Column:
    """Reference mode: count comma-separated pieces of the text (JSON text '[]' counts as 1)."""
    x = col_(c)
    return F.when(x.isNull() | (F.trim(x) == ""), F.lit(0)).otherwise(F.size(F.split(x, ",")))


# --- F18 URL / id extraction ----------------------------------------------------------

BARE_ID_LENGTH = 11
# fixed values: where the video platform's links carry the id. Hosts are matched with their subdomains.
SHORT_HOST, VIDEO_HOST = "youtu.be", "youtube.com"
ID_PARAMETER, EMBED_FOLDER = "v", "embed"


def _on_host(host: Column, name: str) -> Column:
    return (host == name) | host.endswith("." + name)


def extract_url_key(c, key_len: int = BARE_ID_LENGTH, short_host: str = SHORT_HOST, video_host: str = VIDEO_HOST,
                    parameter: str = ID_PARAMETER, folder: str = EMBED_FOLDER) -> Column:
    """the id that a link carries, from the parsed URL: the path of a short link, the id parameter of a page link, the
    segment after the embed folder. A bare token of ``key_len`` characters is an id already; other text stays as it is."""
    s = F.trim(col_(c))
    url = F.when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), s).otherwise(F.concat(F.lit("https://"), s))
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.split(F.try_parse_url(url, F.lit("PATH")), "/")
    query_id = F.try_parse_url(url, F.lit("QUERY"), F.lit(parameter))
    embedded = F.when(F.get(path, F.lit(1)) == folder, F.get(path, F.lit(2)))
    linked = F.when(_on_host(host, short_host), F.get(path, F.lit(1))).when(_on_host(host, video_host), F.coalesce(query_id, embedded))
    bare = F.when((F.length(s) == key_len) & ~s.contains("/"), s)
    return F.coalesce(bare, F.nullif(linked, F.lit("")), s)


# --- F19 formats ------------------------------------------------------------------------

def compact_number(c) -> Column:
    n = F.floor(col_(c).cast("double"))
    return (F.when(n >= 1_000_000_000, F.format_string("%.1fB", n / 1e9))
            .when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6))
            .when(n >= 1_000, F.format_string("%.0fK", n / 1e3))
            .otherwise(n.cast("bigint").cast("string")))


# fixed words of a feature's name that say how its value is shown
PERCENT_WORDS = ("ratio", "loyalty", "depth")


def feature_value_text(feature, value) -> Column:
    """a feature's value as text, by the kind its name tells: a share as percent, views above 1,000 in M or K, a tier (log10)
    as subscribers, a trend as a factor, others with three digits. Ties round to even; a null name or value gives null."""
    f, v = col_(feature), col_(value).cast("double")

    def fixed(x, digits):
        return F.format_string(f"%.{digits}f", F.bround(x, digits))

    share = F.lit(False)
    for w in PERCENT_WORDS:
        share = share | f.contains(w)
    many = F.lower(f).contains("views") & (v > 1000)
    text = (F.when(share, F.concat(fixed(v * 100, 2), F.lit("%")))
            .when(many & (v >= 1_000_000), F.concat(fixed(v / 1e6, 1), F.lit("M")))
            .when(many, F.concat(fixed(v / 1e3, 0), F.lit("K")))
            .when(f.contains("tier"), F.concat(F.format_number(F.pow(F.lit(10.0), v), 0), F.lit(" subscribers")))
            .when(f.contains("trend") & (v == 0), F.lit("N/A"))
            .when(f.contains("trend"), F.concat(fixed(v, 2), F.lit("x")))
            .otherwise(fixed(v, 3)))
    return F.when(f.isNotNull() & v.isNotNull(), text)


# --- F20 hash ---------------------------------------------------------------------------

def surrogate_key(*cols) -> Column:
    parts = [F.coalesce(col_(c).cast("string"), F.lit(SURROGATE_NULL_TOKEN)) for c in cols]
    return F.md5(F.concat_ws(SURROGATE_SEPARATOR, *parts))


# --- F21–F24 bands -----------------------------------------------------------------------

def band(c, edges: Sequence, labels: Sequence, inclusive_upper: bool = True, descending: bool = False,
         default=None) -> Column:
    """Generic banding.

    ascending (default): first label whose upper edge holds (``<=`` or ``<``), last label otherwise.
    descending: edges are lower bounds from the top; first label whose ``>=`` edge holds,
    ``default`` (or the last label) otherwise.
    """
    x = col_(c)
    if descending:
        assert len(labels) in (len(edges), len(edges) + 1)
        expr = None
        for e, lab in zip(edges, labels):
            cond = x >= F.lit(e)
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        tail = labels[len(edges)] if len(labels) > len(edges) else default
        return expr.otherwise(F.lit(tail))
    assert len(labels) == len(edges) + 1
    expr = None
    for e, lab in zip(edges, labels[:-1]):
        cond = (x <= F.lit(e)) if inclusive_upper else (x < F.lit(e))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def length_class(seconds) -> Column:
    """<=60 shorts, <=600 short, <=1800 medium, else long."""
    return band(seconds, LENGTH_EDGES, LENGTH_LABELS)


def engagement_level(likes, views) -> Column:
    """views = 0 -> low; like/view >= .05 high, >= .02 medium, else (and NULL) low."""
    lv, vv = col_(likes), col_(views)
    ratio = F.try_divide(lv.cast("double"), vv.cast("double"))
    return (F.when(vv == 0, F.lit("low"))
            .when(ratio >= ENGAGEMENT_HIGH, F.lit("high"))
            .when(ratio >= ENGAGEMENT_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))


def crawl_priority(subs) -> Column:
    """priority 5..1 from subscribers; non-numeric -> 0 subscribers."""
    s = coerce(subs, "bigint", 0) if isinstance(subs, str) else F.coalesce(col_(subs).try_cast("bigint"), F.lit(0))
    return band(s, (5_000_000, 1_000_000, 100_000, 10_000), (5, 4, 3, 2, 1), descending=True)


def refresh_hours(subs, videos) -> Column:
    """12 h for >= 1M subs or > 1 upload/day, 24 h for >= 100K, else 48; non-numeric -> 24."""
    s = col_(subs).try_cast("bigint")
    v = col_(videos).try_cast("bigint")
    freq = F.when(v > 0, v / 365.0).otherwise(F.lit(0.0))
    return (F.when(s.isNull() | v.isNull(), F.lit(24))
            .when((s >= 1_000_000) | (freq > 1), F.lit(12))
            .when(s >= 100_000, F.lit(24)).otherwise(F.lit(48)))


# fixed values: band tables for F24 (edges descending, label list one longer = fall-through)
PROBABILITY_LABELS = ((0.85, 0.70, 0.55, 0.40), ("EXTREMELY HIGH", "HIGH", "MEDIUM", "LOW", "VERY LOW"))
SUBSCRIBER_TIERS = ((100_000_000, 10_000_000, 1_000_000, 100_000),
                    ("Mega Channels (100M+ sub)", "Large Channels (10M–100M sub)",
                     "Established Channels (1M–10M sub)", "Growing Channels (100K–1M sub)",
                     "Niche Channels (<100K sub)"))
MOMENTUM_LABELS = ((70, 50), ("ACCELERATING", "STABLE", "SLOWING"))
RECOMMENDATIONS = ((0.75, 0.50, 0.30), ("boost_now", "watch", "improve", "unlikely"))
TREND_UP, TREND_DOWN = 1.05, 0.95
QUOTA_STATUS = ((90, 80, 50), ("CRITICAL", "WARNING", "MODERATE", "OK"))


def confidence_band(p) -> Column:
    """high when p >= .80 or <= .20; medium when >= .65 or <= .35; else low."""
    x = col_(p)
    return (F.when((x >= 0.80) | (x <= 0.20), F.lit("high"))
            .when((x >= 0.65) | (x <= 0.35), F.lit("medium")).otherwise(F.lit("low")))


# --- F25 / F26 encodings and flags ----------------------------------------------------

def level_code(c) -> Column:
    x = F.coalesce(col_(c), F.lit("low"))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in LEVEL_CODES.items() for v in kv]), x),
                      F.lit(0)).cast("int")


def time_flags(hour, dow, month) -> dict[str, Column]:
    h, d, m = col_(hour), col_(dow), col_(month)
    return {
        "is_weekend": d.isin(1, 7).cast("int"),
        "is_prime_time": h.between(18, 22).cast("int"),
        "is_morning": h.between(6, 10).cast("int"),
        "is_lunch_slot": h.between(11, 13).cast("int"),
        "publish_quarter": (F.floor((m - 1) / 3) + 1).cast("int"),
    }


def round_doubles(df, digits: int = 6):
    """Round every DOUBLE/FLOAT column (used by the comparison catalog)."""
    from pyspark.sql.types import DoubleType, FloatType
    return df.select([F.round(F.col(f.name), digits).alias(f.name)
                      if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                      for f in df.schema.fields])
