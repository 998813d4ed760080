"""Raw JSON envelope tables (S01–S04) and JSON flattening.

Envelope = (id, parent keys, raw JSON text, ingestion_time), append-only, partitioned by ingestion day.
Flattening parses the raw column ONCE with ``from_json`` against a schema pruned to the requested
paths (every leaf read as text = JSON_VALUE / JSON_QUERY semantics), then casts: N paths cost one parse,
not N ``get_json_object`` scans.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import scalar_text
from . import fixtures as fx

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# ------------------------------------------------------------------------------------------------
# S03 envelope builders
# ------------------------------------------------------------------------------------------------


def envelope(records: DataFrame, id_col: Column, payload: Column, ingestion_time: Column,
             parents: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Wrap records as (id, parents..., raw = JSON text, ingestion_time); rows with empty ids are dropped.
    ``id_col`` may be an object id (use ``coalesce(obj.videoId, obj)``-style expressions upstream)."""
    out = records.select(id_col.cast("string").alias("id"), *[c.cast("string").alias(n) for n, c in parents],
                         F.to_json(payload).alias("raw"), ingestion_time.alias("ingestion_time"))
    return out.where(F.col("id").isNotNull() & (F.col("id") != ""))


def raw_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video API records built from the item fixture. Hidden counts, missing privacy / duration and
    private items are deterministic functions of the key, so staging filters have work to do."""
    it = fx.items(spark, sf_dir)
    k = F.col("video_id")
    payload = F.struct(
        F.struct(F.col("channel_id").cast("string").alias("channelId"), "title", "description",
                 F.from_json("tags", T.ArrayType(T.StringType())).alias("tags"),
                 F.col("category_id").alias("categoryId"), F.when(k % 5 != 0, F.col("default_language")).alias("defaultLanguage"),
                 F.when(k % 3 != 0, F.when(k % 2 == 0, F.lit("de")).otherwise(F.lit("fr"))).alias("defaultAudioLanguage"),
                 F.date_format("published_at", ISO_Z).alias("publishedAt")).alias("snippet"),
        F.struct(F.col("view_count").cast("string").alias("viewCount"),
                 F.when(k % 13 != 0, F.col("like_count").cast("string")).alias("likeCount"),
                 F.when(k % 17 != 0, F.col("comment_count").cast("string")).alias("commentCount")).alias("statistics"),
        F.struct(F.when(k % 53 != 0, F.col("duration_iso8601")).alias("duration"),
                 F.when(F.col("has_caption"), F.lit("true")).otherwise(F.lit("false")).alias("caption"),
                 "definition").alias("contentDetails"),
        F.struct(F.when(k % 37 == 0, F.lit("private")).when(k % 41 == 0, F.lit(None))
                  .otherwise(F.lit("public")).alias("privacyStatus"),
                 F.col("is_embeddable").alias("embeddable"), F.col("is_made_for_kids").alias("madeForKids"))
        .alias("status"))
    return envelope(it, k, payload, F.col("crawled_at"))


def raw_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel API responses ({items: [ {...} ]}); every 29th owner comes back with an empty item list."""
    ow = fx.owners(spark, sf_dir)
    k = F.col("channel_id")
    item = F.struct(
        F.struct(F.col("channel_name").alias("title"), F.col("segment").alias("description"),
                 F.date_format("channel_created_at", ISO_Z).alias("publishedAt"),
                 F.col("country_code").alias("country"),
                 F.concat(F.lit("@c"), k.cast("string")).alias("customUrl")).alias("snippet"),
        F.struct(F.col("subscriber_count").cast("string").alias("subscriberCount"),
                 (F.col("subscriber_count") * 10).cast("string").alias("viewCount"),
                 (k % 50).cast("string").alias("videoCount"),
                 F.when(F.col("subscriber_count") == 0, F.lit("true")).otherwise(F.lit("false"))
                  .alias("hiddenSubscriberCount")).alias("statistics"),
        F.struct(F.struct(F.concat(F.lit("UU"), k.cast("string")).alias("uploads")).alias("relatedPlaylists"))
        .alias("contentDetails"),
        F.struct(F.array(F.col("segment"), F.col("country_code")).alias("topicIds")).alias("topicDetails"))
    payload = F.struct(F.when(k % 29 == 0, F.filter(F.array(item), lambda _: F.lit(False)))
                       .otherwise(F.array(item)).alias("items"))
    return envelope(ow, k, payload, F.col("crawled_at"))


def raw_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uploads playlist per owner with the owner's item count; every 4th is private."""
    ow = fx.owners(spark, sf_dir)
    cnt = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("channel_id")).agg(
        F.count(F.lit(1)).alias("n"))
    d = ow.join(cnt, "channel_id", "left")
    k = F.col("channel_id")
    payload = F.struct(
        F.struct(F.concat(F.col("channel_name"), F.lit(" uploads")).alias("title"),
                 F.col("segment").alias("description"),
                 F.date_format("channel_created_at", ISO_Z).alias("publishedAt")).alias("snippet"),
        F.struct(F.coalesce(F.col("n"), F.lit(0)).cast("string").alias("itemCount")).alias("contentDetails"),
        F.struct(F.when(k % 4 == 0, F.lit("private")).otherwise(F.lit("public")).alias("privacyStatus"))
        .alias("status"))
    return envelope(d, F.concat(F.lit("PL"), k.cast("string")), payload, F.col("crawled_at"),
                    parents=[("channel_id", k)])


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment-thread records built from conversations: one thread per (conversation, turn), parent item
    = conversation, author = role, likes / replies from the turn number."""
    c = fx.table(spark, sf_dir, "conversations")
    ts = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("conv_id") % 1000).cast("int"))
          + F.make_dt_interval(mins=F.col("turn").cast("int")))
    payload = F.struct(
        F.struct(F.struct(F.struct(F.col("role").alias("authorDisplayName"), F.col("text").alias("textDisplay"),
                                   (F.col("turn") * 3).alias("likeCount"),
                                   F.date_format(ts, ISO_Z).alias("publishedAt")).alias("snippet"))
                 .alias("topLevelComment"), (F.col("turn") % 4).alias("totalReplyCount")).alias("snippet"))
    return envelope(c, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), payload,
                    F.lit(fx.CRAWLED_AT).cast("timestamp"),
                    parents=[("video_id", F.col("conv_id")), ("channel_id", F.col("conv_id") % 50)])


def write_envelopes(df: DataFrame, path: str, key: str = "id", mode: str = "append") -> None:
    """Append to a day-partitioned table, rows clustered by key inside each day. Range partitions over (day, key)
    give a large day many write tasks."""
    (df.withColumn("ingest_date", F.to_date("ingestion_time"))
       .repartitionByRange("ingest_date", key).sortWithinPartitions("ingest_date", key)
       .write.mode(mode).partitionBy("ingest_date").parquet(path))


ENVELOPE_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("raw", T.StringType()),
                                T.StructField("ingestion_time", T.TimestampType())])


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType = ENVELOPE_SCHEMA) -> DataFrame:
    """Newline-delimited JSON with a fixed schema (no inference)."""
    return spark.read.schema(schema).json(path)


# ------------------------------------------------------------------------------------------------
# single-pass JSON path extraction
# ------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\.([A-Za-z_][A-Za-z0-9_]*)|\[(\d+)\]")


def _parse_path(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError(f"JSON path must start with $: {path}")
    toks: list[str | int] = []
    pos = 1
    for m in _TOKEN.finditer(path, 1):
        if m.start() != pos:
            raise ValueError(f"unsupported JSON path {path}")
        toks.append(m.group(1) if m.group(1) is not None else int(m.group(2)))
        pos = m.end()
    if pos != len(path):
        raise ValueError(f"unsupported JSON path {path}")
    return toks


def _schema_for(paths: Mapping[tuple, str]) -> T.DataType:
    """Nested schema holding exactly the requested paths. Leaves of kind ``value`` are read as VARIANT, which knows a text
    that begins with a bracket from an array or object; other leaves are read as text."""
    def build(node) -> T.DataType:
        if isinstance(node, str):
            return T.VariantType() if node == "value" else T.StringType()
        if "[]" in node:
            return T.ArrayType(build(node["[]"]))
        return T.StructType([T.StructField(k, build(v)) for k, v in node.items()])

    tree: dict = {}  # leaves are kinds, inner nodes dicts
    for toks, kind in paths.items():
        node = tree
        for i, t in enumerate(toks):
            key = "[]" if isinstance(t, int) else t
            last = i == len(toks) - 1
            if last:
                node.setdefault(key, kind)
            else:
                if not isinstance(node.get(key), dict):
                    node[key] = {}
                node = node[key]
    return build(tree)


def extract_json(df: DataFrame, raw: str, fields: Mapping[str, tuple[str, str]], keep: Sequence[str] = (),
                 strict: bool = True) -> DataFrame:
    """Project ``fields = {alias: (path, kind)}`` from the JSON text column ``raw`` in one parse.

    kind: ``value`` (JSON_VALUE: scalar text, NULL for objects/arrays), ``query`` (JSON_QUERY: subtree
    as JSON text), ``bigint`` / ``boolean`` / ``double`` (JSON_VALUE then CAST), ``timestamp``
    (ISO-8601 text -> TIMESTAMP), ``array_len`` (length of the JSON array at the path).
    ``strict`` keeps CAST (raises on malformed values, as the warehouse does); otherwise TRY_CAST.
    """
    parsed = {a: _parse_path(p) for a, (p, _) in fields.items()}
    variants = {tuple(t) for a, t in parsed.items() if fields[a][1] == "value"}
    schema = _schema_for({tuple(t): "value" if tuple(t) in variants else "text" for t in parsed.values()})
    # parse once. The parsed struct comes out of a one-element explode (a Generate), so filters on the
    # extracted fields stay above it: predicate pushdown would otherwise inline from_json into every
    # predicate that references a field (one full JSON parse per predicate and row).
    keep_cols = [F.col(k) if isinstance(k, str) else k for k in keep]
    kept = df.select(*keep_cols, F.explode(F.array(F.from_json(F.col(raw), schema))).alias("_j"))
    names = [c for c in kept.columns if c != "_j"]
    cols = []
    for alias, (_, kind) in fields.items():
        c = F.col("_j")
        for t in parsed[alias]:
            c = c[t] if isinstance(t, int) else c.getField(t)
        variant = tuple(parsed[alias]) in variants
        subtree = F.to_json(c) if variant else c
        if kind == "array_len":
            cols.append(F.json_array_length(subtree).alias(alias))
            continue
        if kind == "query":
            cols.append(subtree.alias(alias))
            continue
        # as text, a number, date or boolean never begins with a bracket
        v = scalar_text(c) if variant else F.when(c.startswith("{") | c.startswith("["), F.lit(None)).otherwise(c)
        if kind == "value":
            cols.append(v.alias(alias))
        elif kind == "timestamp":
            cols.append((v.cast("timestamp") if strict else v.try_cast("timestamp")).alias(alias))
        else:
            cols.append((v.cast(kind) if strict else v.try_cast(kind)).alias(alias))
    return kept.select(*names, *cols)


# ------------------------------------------------------------------------------------------------
# P01–P07 staging relations
# ------------------------------------------------------------------------------------------------

VIDEO_PATHS = {
    "channel_id": ("$.snippet.channelId", "value"),
    "title": ("$.snippet.title", "value"),
    "description": ("$.snippet.description", "value"),
    "tags": ("$.snippet.tags", "query"),
    "category_id": ("$.snippet.categoryId", "value"),
    "default_language": ("$.snippet.defaultLanguage", "value"),
    "published_at": ("$.snippet.publishedAt", "timestamp"),
    "view_count": ("$.statistics.viewCount", "bigint"),
    "like_count": ("$.statistics.likeCount", "bigint"),
    "comment_count": ("$.statistics.commentCount", "bigint"),
    "duration_iso8601": ("$.contentDetails.duration", "value"),
    "has_caption": ("$.contentDetails.caption", "boolean"),
    "definition": ("$.contentDetails.definition", "value"),
    "privacy_status": ("$.status.privacyStatus", "value"),
    "is_embeddable": ("$.status.embeddable", "boolean"),
    "is_made_for_kids": ("$.status.madeForKids", "boolean"),
}

# the lenient flatten also reads the audio language, which stands in for a missing text language
LENIENT_VIDEO_PATHS = {**VIDEO_PATHS, "audio_language": ("$.snippet.defaultAudioLanguage", "value")}

CHANNEL_PATHS = {
    "channel_name": ("$.items[0].snippet.title", "value"),
    "description": ("$.items[0].snippet.description", "value"),
    "channel_created_at": ("$.items[0].snippet.publishedAt", "timestamp"),
    "country_code": ("$.items[0].snippet.country", "value"),
    "custom_url": ("$.items[0].snippet.customUrl", "value"),
    "subscriber_count": ("$.items[0].statistics.subscriberCount", "bigint"),
    "total_view_count": ("$.items[0].statistics.viewCount", "bigint"),
    "video_count": ("$.items[0].statistics.videoCount", "bigint"),
    "has_hidden_subscribers": ("$.items[0].statistics.hiddenSubscriberCount", "boolean"),
    "uploads_playlist_id": ("$.items[0].contentDetails.relatedPlaylists.uploads", "value"),
    "topic_ids": ("$.items[0].topicDetails.topicIds", "query"),
}

COMMENT_PATHS = {
    "author": ("$.snippet.topLevelComment.snippet.authorDisplayName", "value"),
    "text": ("$.snippet.topLevelComment.snippet.textDisplay", "value"),
    "like_count": ("$.snippet.topLevelComment.snippet.likeCount", "bigint"),
    "published_at": ("$.snippet.topLevelComment.snippet.publishedAt", "timestamp"),
    "reply_count": ("$.snippet.totalReplyCount", "bigint"),
}

PLAYLIST_PATHS = {
    "playlist_name": ("$.snippet.title", "value"),
    "description": ("$.snippet.description", "value"),
    "created_at": ("$.snippet.publishedAt", "timestamp"),
    "item_count": ("$.contentDetails.itemCount", "bigint"),
    "privacy_status": ("$.status.privacyStatus", "value"),
}


def passthrough(df: DataFrame, columns: Sequence[Mapping[str, str]]) -> list[Column]:
    """Extra columns ``[{name, alias?}]`` appended to a projection."""
    return [F.col(c["name"]).alias(c.get("alias") or c["name"]) for c in columns]


def valid_channel_ids(raw_ch: DataFrame) -> DataFrame:
    """Channels whose response has a non-empty item list."""
    return raw_ch.where(F.json_array_length(F.get_json_object("raw", "$.items")) > 0) \
        .select(F.col("id").alias("channel_id"))


def stg_channels(raw_ch: DataFrame, passthrough_cols: Sequence[Mapping[str, str]] = ()) -> DataFrame:
    """P01 + P04: flattened channel responses with a non-empty item list."""
    d = raw_ch.where(F.json_array_length(F.get_json_object("raw", "$.items")) > 0)
    return extract_json(d, "raw", CHANNEL_PATHS,
                        keep=[F.col("id").alias("channel_id"),
                              F.col("ingestion_time").cast("timestamp").alias("crawled_at"),
                              *passthrough(d, passthrough_cols)])


def stg_videos(raw_v: DataFrame, raw_ch: DataFrame, passthrough_cols: Sequence[Mapping[str, str]] = ()) -> DataFrame:
    """P02 + P05 (NULL privacy counts as public) + P06 (duration present) + J02 (channel has items).

    J02 is a semi-join: identical to the reference's inner join when channel ids are unique, and it cannot
    multiply rows when the raw channel table holds duplicate snapshots."""
    f = extract_json(raw_v, "raw", VIDEO_PATHS,
                     keep=[F.col("id").alias("video_id"), F.col("ingestion_time").cast("timestamp").alias("crawled_at"),
                           *passthrough(raw_v, passthrough_cols)])
    f = (f.withColumn("like_count", F.coalesce("like_count", F.lit(0).cast("bigint")))
          .withColumn("comment_count", F.coalesce("comment_count", F.lit(0).cast("bigint")))
          .withColumn("privacy_status", F.coalesce("privacy_status", F.lit("public"))))
    f = f.where((F.col("privacy_status") == "public") & F.col("duration_iso8601").isNotNull())
    return f.join(valid_channel_ids(raw_ch), "channel_id", "left_semi")


def stg_playlists(raw_p: DataFrame, raw_ch: DataFrame) -> DataFrame:
    """P03 + P05 (strict: NULL privacy is dropped) + J02."""
    f = extract_json(raw_p, "raw", PLAYLIST_PATHS,
                     keep=[F.col("id").alias("playlist_id"), "channel_id",
                           F.col("ingestion_time").cast("timestamp").alias("crawled_at")])
    f = f.where(F.col("privacy_status") == "public")
    return f.join(valid_channel_ids(raw_ch), "channel_id", "left_semi")


def stg_comments(raw_c: DataFrame) -> DataFrame:
    """Flattened comment threads (declared paths only; the same single-parse operator as P02)."""
    return extract_json(raw_c, "raw", COMMENT_PATHS,
                        keep=[F.col("id").alias("comment_id"), "video_id", "channel_id",
                              F.col("ingestion_time").cast("timestamp").alias("crawled_at")])
