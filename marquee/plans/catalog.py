"""Queries over listings, sources, parsing and the index."""

import datetime
import uuid

from pyspark.sql import functions as F

from marquee.functions import parse
from marquee.functions.text import normalized_title, redacted, title_tokens
from marquee.operators import catalog as c
from marquee.operators import filters as f
from marquee.operators import index as i
from marquee.operators.jobs import plan_hash, selection_hash
from marquee.operators.ordering import before
from marquee.plans.registry import ORACLE_SQL, query
from marquee.sources.buckets import BucketedTable
from marquee.sources.rejects import write_checked
from marquee.sources.tables import shared_dir, write_index_tables

# --- listings -------------------------------------------------------------------------------------------------------
_J = "CASE WHEN starts_with(entry, '{') THEN entry END"
_G = lambda name: f"json_extract_string({_J}, '$.{name}')"
_USABLE = f"SELECT *, trim({_G('id')}) AS k FROM entries WHERE starts_with(entry, '{{') AND coalesce(trim({_G('id')}), '') <> ''"

query(
    "s1_explode_listings",
    f"""SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY pos) - 1 AS position, k AS media_key, coalesce(nullif(trim({_G('title')}), ''), 'Unavailable video') AS title,
 CASE WHEN {_G('url')} LIKE 'https://%' THEN {_G('url')} ELSE 'https://www.youtube.com/watch?v=' || k END AS url, TRY_CAST({_G('duration')} AS DOUBLE) AS duration_seconds,
 CASE WHEN TRY_CAST({_G('view_count')} AS BIGINT) >= 0 THEN TRY_CAST({_G('view_count')} AS BIGINT) END AS view_count,
 coalesce(nullif({_G('channel')}, ''), {_G('uploader')}, 'Parent') AS channel, 'unknown' AS availability, CASE WHEN {_G('live_status')} = 'was_live' THEN 'stream' ELSE 'video' END AS media_type FROM ({_USABLE}) u""",
)(lambda v: c.explode_listings(v.listings).select("source_id", "position", "media_key", "title", "url", "duration_seconds", "view_count", "channel", "availability", "media_type"))
query(
    "s2_listing_audit",
    f"""SELECT source_id, 'List ' || source_id AS title, CASE WHEN length(source_id) = 4 THEN 12 ELSE 99 END::BIGINT AS reported_count,
 count(*) FILTER (starts_with(entry, '{{') AND coalesce(trim({_G('id')}), '') <> '') AS item_count, count(*) FILTER (NOT (starts_with(entry, '{{') AND coalesce(trim({_G('id')}), '') <> '')) AS skipped_entries FROM entries GROUP BY source_id""",
)(lambda v: c.listing_audit(v.listings))
query("s3_clean_metadata", "SELECT media_key, nullif(trim(channel), '') AS channel, CASE WHEN view_count - 100000 >= 0 THEN view_count - 100000 END AS view_count, duration_seconds FROM media")(
    lambda v: c.clean_metadata(v.media.selectExpr("media_key", "concat(' ', channel, ' ') AS channel", "CAST(view_count - 100000 AS STRING) AS view_count", "CAST(duration_seconds AS STRING) AS duration_seconds"), ["channel"], ["view_count", "duration_seconds"])
)
query("s4_derive_media_type", "SELECT media_key, CASE WHEN position % 3 = 0 THEN 'short' WHEN position % 3 = 1 OR availability = 'public' THEN 'stream' ELSE 'video' END AS derived FROM media")(
    lambda v: v.media.select("media_key", c.derive_media_type(F.expr("CASE position % 3 WHEN 0 THEN 'channel_shorts' WHEN 1 THEN 'channel_streams' ELSE 'playlist' END"), F.expr("CASE WHEN availability = 'public' THEN ' was_live ' ELSE 'not_live' END")).alias("derived"))
)
query(
    "s5_playlist_catalog",
    f"""SELECT source_id, position, playlist_id, title, url, item_count FROM (SELECT source_id, pos AS position, k AS playlist_id, coalesce(nullif(trim({_G('title')}), ''), 'Playlist ' || k) AS title,
 CASE WHEN {_G('url')} LIKE 'https://%' THEN {_G('url')} ELSE 'https://www.youtube.com/playlist?list=' || k END AS url,
 CASE WHEN {_G('playlist_count')} = '0' THEN TRY_CAST({_G('n_entries')} AS BIGINT) ELSE TRY_CAST(coalesce({_G('playlist_count')}, {_G('n_entries')}) AS BIGINT) END AS item_count,
 row_number() OVER (PARTITION BY source_id, k ORDER BY pos) AS n FROM ({_USABLE}) u) t WHERE n = 1""",
)(lambda v: c.playlist_catalog(v.listings))
query(
    "s6_fill_item_counts",
    "SELECT media_key AS playlist_id, coalesce(view_count, CASE WHEN position % 3 <> 0 AND position - 100 >= 0 THEN position - 100 END) AS item_count FROM media",
)(lambda v: c.fill_item_counts(v.media.selectExpr("media_key AS playlist_id", "view_count AS item_count"), v.media.filter("position % 3 <> 0").selectExpr("media_key AS playlist_id", "position - 100 AS probed")))
_RESOLVED = """SELECT url, CASE WHEN url LIKE 'https://www.youtube.com/watch?v=%' THEN substr(url, 33) WHEN url LIKE 'https://youtu.be/%' THEN substr(url, 18) WHEN url LIKE 'https://www.youtube.com/playlist?list=%' THEN substr(url, 39)
 WHEN url LIKE '@%' THEN url WHEN url LIKE 'https://youtube.com/shorts/%' THEN substr(url, 28) WHEN url LIKE 'youtube.com/@%' THEN substr(url, 13) WHEN url LIKE 'https://www.youtube.com/channel/%' THEN substr(url, 33) END AS source_key,
 CASE WHEN url LIKE '%playlist?list=%' AND url LIKE '%youtube%' THEN 'playlist' WHEN url LIKE '@%' OR url LIKE 'youtube.com/@%' OR url LIKE '%youtube.com/channel/%' THEN 'channel' WHEN url LIKE '%youtube.com/%' OR url LIKE '%youtu.be/%' THEN 'video' END AS kind,
 CASE WHEN url LIKE 'ftp:%' THEN 'scheme' WHEN url LIKE '%youtu%' OR url LIKE '@%' THEN NULL ELSE 'host' END AS reject FROM urls"""
query("s7_resolve_sources", f"SELECT url, CASE WHEN reject IS NULL THEN kind END AS kind, CASE WHEN reject IS NULL THEN source_key END AS source_key, reject FROM ({_RESOLVED}) r")(lambda v: c.resolve_sources(v.urls).select("url", "kind", "source_key", "reject"))
query(
    "s7_build_source_catalog",
    f"""SELECT 'youtube' AS platform, kind, source_key, CASE WHEN kind = 'video' THEN 'https://www.youtube.com/watch?v=' || source_key WHEN kind = 'playlist' THEN 'https://www.youtube.com/playlist?list=' || source_key
 ELSE 'https://www.youtube.com/' || CASE WHEN source_key LIKE '@%' THEN '' ELSE 'channel/' END || source_key END AS canonical_url, count(*) AS n_inputs FROM ({_RESOLVED}) r WHERE reject IS NULL GROUP BY kind, source_key""",
)(lambda v: c.build_source_catalog(v.urls).drop("root_url"))
query("s7_reject_counts", f"SELECT reject, kind, count(*) AS n FROM (SELECT reject, CASE WHEN reject IS NULL THEN kind END AS kind FROM ({_RESOLVED}) r) t GROUP BY reject, kind")(lambda v: c.resolve_sources(v.urls).groupBy("reject", "kind").agg(F.count("*").alias("n")))
query(
    "s8_expand_channel_tabs",
    f"""SELECT source_key, 'channel_' || tab AS kind, 'https://www.youtube.com/' || CASE WHEN source_key LIKE '@%' THEN '' ELSE 'channel/' END || source_key || '/' || tab AS canonical_url
 FROM (SELECT DISTINCT kind, source_key FROM ({_RESOLVED}) r WHERE reject IS NULL AND kind = 'channel') s CROSS JOIN (VALUES ('videos'), ('shorts'), ('streams')) t(tab)
 UNION ALL SELECT DISTINCT source_key, kind, 'https://www.youtube.com/playlist?list=' || source_key FROM ({_RESOLVED}) r WHERE kind = 'playlist' AND reject IS NULL""",
)(lambda v: c.expand_channel_tabs(c.build_source_catalog(v.urls)).select("source_key", "kind", "canonical_url"))
query("s9_read_catalog", "SELECT source_id, media_key, position, title, view_count, like_count FROM media WHERE position % 12 <> 0 AND source_id IN ('src1', 'src7')")(
    lambda v: c.read_catalog(
        v.media.filter("source_id IN ('src1', 'src7')"), v.media.selectExpr("source_id", "media_key", "position", "position % 12 <> 0 AS is_present"), v.media.select("media_key", "title"),
        v.media.filter("view_count IS NOT NULL OR like_count IS NOT NULL").select("media_key", "view_count", "like_count"),
    ).select("source_id", "media_key", "position", "title", "view_count", "like_count").orderBy("source_id", "position", "media_key")
)
query("s15_write_index_tables", "SELECT 'media_items' AS name, count(DISTINCT media_key) AS n FROM media UNION ALL SELECT 'source_media', count(*) FROM media UNION ALL SELECT 'source_scans', count(DISTINCT source_id) FROM media")(lambda v: _write(v))


def _write(v):
    media = v.media
    tables = {"media_items": media.select("media_key", "title", "availability").dropDuplicates(["media_key"]), "source_media": media.select("source_id", "media_key", "position"), "source_scans": media.groupBy("source_id").agg(F.count("*").alias("n"))}
    paths = write_index_tables(tables, f"{shared_dir(v.spark)}/index-{uuid.uuid4().hex}", "v1")
    out = [v.spark.read.parquet(p).groupBy(F.lit(n).alias("name")).agg(F.count("*").alias("n")) for n, p in sorted(paths.items())]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- parsing --------------------------------------------------------------------------------------------------------
_COUNT_TEXT = "CASE position % 7 WHEN 0 THEN CAST(view_count AS STRING) WHEN 1 THEN CAST(view_count % 90 AS STRING) || '.50 L' WHEN 2 THEN CAST(view_count % 900 AS STRING) || 'm' WHEN 3 THEN '1.2345k' WHEN 4 THEN '-' || CAST(view_count AS STRING) WHEN 5 THEN CAST(view_count AS STRING) || ' Cr' ELSE '9999999999b' END"
_COUNT_SQL = "CASE position % 7 WHEN 0 THEN view_count WHEN 1 THEN (view_count % 90) * 100000 + 50000 WHEN 2 THEN (view_count % 900) * 1000000 WHEN 5 THEN view_count * 10000000 WHEN 6 THEN NULL END"
query("p1_normalize_counts", f"SELECT media_key, {_COUNT_SQL} AS value, CASE WHEN ({_COUNT_SQL}) IS NULL THEN {_COUNT_TEXT} END AS reject FROM media")(
    lambda v: parse.normalized(v.media.selectExpr("media_key", f"{_COUNT_TEXT} AS raw"), "raw", parse.parse_count(F.col("raw"))).drop("raw")
)
query("p1_reject_counts", f"SELECT CASE WHEN ({_COUNT_SQL}) IS NOT NULL THEN 'ok' WHEN ({_COUNT_TEXT}) IS NULL THEN 'empty' ELSE 'unreadable' END AS outcome, count(*) AS n FROM media GROUP BY 1")(
    lambda v: parse.reject_counts(parse.normalized(v.media.selectExpr(f"{_COUNT_TEXT} AS raw"), "raw", parse.parse_count(F.col("raw"))))
)
_MINUTES = "CAST(position % 50 AS STRING)"
query(
    "p2_normalize_durations",
    f"SELECT media_key, CAST(CASE position % 6 WHEN 0 THEN position % 50 WHEN 1 THEN (position % 50) * 60 WHEN 2 THEN (position % 50 + 0.5) * 3600 WHEN 3 THEN (position % 50 + 100) * 60 + 7 WHEN 4 THEN 7200 + (position % 50) * 60 + 59 END AS DOUBLE) AS value FROM media",
)(
    lambda v: v.media.selectExpr("media_key", f"CASE position % 6 WHEN 0 THEN {_MINUTES} || 's' WHEN 1 THEN {_MINUTES} || ' m' WHEN 2 THEN {_MINUTES} || '.5h' WHEN 3 THEN CAST(position % 50 + 100 AS STRING) || ':07' WHEN 4 THEN '2:' || {_MINUTES} || ':59' ELSE {_MINUTES} || ':60' END AS raw").select("media_key", parse.parse_duration(F.col("raw")).alias("value"))
)
query("p3_normalize_dates", "SELECT media_key, CASE WHEN position % 5 <> 0 THEN upload_date END AS value FROM media")(
    lambda v: v.media.selectExpr("media_key", "CASE WHEN position % 5 = 0 THEN '1994-02-30' WHEN position % 2 = 0 THEN date_format(upload_date, 'yyyyMMdd') ELSE CAST(upload_date AS STRING) END AS raw").select("media_key", parse.parse_date(F.col("raw")).alias("value"))
)
_HEIGHT = "CAST(position % 20000 AS STRING)"
query(
    "p4_normalize_profile_labels",
    """SELECT media_key, CASE WHEN position % 4 = 0 THEN 'best' WHEN position % 4 = 1 THEN 'lowest' WHEN position % 20000 BETWEEN 144 AND 16384 THEN CASE WHEN position % 4 = 2 THEN 'exact:' ELSE '' END || CAST(position % 20000 AS STRING) || 'p' END AS video_label,
 CASE WHEN position % 600 BETWEEN 32 AND 512 THEN CAST(position % 600 AS STRING) || 'k' END AS audio_label FROM media""",
)(
    lambda v: v.media.selectExpr("media_key", f"CASE position % 4 WHEN 0 THEN ' Best' WHEN 1 THEN 'worst' WHEN 2 THEN 'EXACT:' || {_HEIGHT} ELSE {_HEIGHT} || 'P' END AS q", "CAST(position % 600 AS STRING) || 'kbps' AS a")
    .select("media_key", parse.parse_video_quality(F.col("q"))["label"].alias("video_label"), parse.parse_audio_quality(F.col("a"))["label"].alias("audio_label"))
)
#: Raw input of every sort, and why each text can't be read.
_RAW = {
    "count": _COUNT_TEXT, "duration": f"CASE position % 6 WHEN 0 THEN {_MINUTES} || 's' WHEN 1 THEN {_MINUTES} || ' m' WHEN 2 THEN {_MINUTES} || '.5h' WHEN 3 THEN CAST(position % 50 + 100 AS STRING) || ':07' WHEN 4 THEN '2:' || {_MINUTES} || ':59' ELSE {_MINUTES} || ':60' END",
    "day": "CASE WHEN position % 5 = 0 THEN '1994-02-30' WHEN position % 2 = 0 THEN date_format(upload_date, 'yyyyMMdd') ELSE CAST(upload_date AS STRING) END",
    "video": f"CASE position % 4 WHEN 0 THEN ' Best' WHEN 1 THEN 'worst' WHEN 2 THEN 'EXACT:' || {_HEIGHT} ELSE {_HEIGHT} || 'P' END", "audio": "CAST(position % 600 AS STRING) || 'kbps'",
}
_WHY = {
    "count": "CASE WHEN position % 7 = 3 THEN 'not whole' WHEN position % 7 = 6 THEN 'too large' WHEN view_count IS NULL THEN 'empty' WHEN position % 7 = 4 THEN 'negative' END", "duration": "CASE WHEN position % 6 = 5 THEN 'above 59' END",
    "day": "CASE WHEN position % 5 = 0 THEN 'no such day' WHEN upload_date IS NULL THEN 'empty' END", "video": "CASE WHEN position % 4 IN (2, 3) AND NOT position % 20000 BETWEEN 144 AND 16384 THEN 'height out of range' END",
    "audio": "CASE WHEN NOT position % 600 BETWEEN 32 AND 512 THEN 'rate out of range' END",
}
_REASONS = {"count": parse.count_reason, "duration": parse.duration_reason, "day": parse.date_reason, "video": parse.video_quality_reason, "audio": parse.audio_quality_reason}
_CHECKED = f"(SELECT source_id, media_key, {', '.join(f'{w} AS {k}' for k, w in _WHY.items())} FROM media)"


def _checked(v):
    """Clean rows, rejects and counts of the raw input, from the pass that writes it."""
    raw = v.media.selectExpr("source_id", "media_key", *[f"{t} AS {k}" for k, t in _RAW.items()])
    return write_checked(raw, f"{shared_dir(v.spark)}/checked-{uuid.uuid4().hex}", {k: f(F.col(k)) for k, f in _REASONS.items()}, parse.REASONS)


for _name, _rules in (("p1_count_rejects", ("count",)), ("p2_duration_rejects", ("duration",)), ("p3_date_rejects", ("day",)), ("p4_label_rejects", ("video", "audio"))):
    query(_name, " UNION ALL ".join(f"SELECT source_id, media_key, '{k}' AS rule, {k} AS reason FROM {_CHECKED} c WHERE {k} IS NOT NULL" for k in _rules))(
        lambda v, rules=_rules: _checked(v)[1].select("source_id", "media_key", F.explode("reasons").alias("rule", "reason")).filter(F.col("rule").isin(*rules))
    )
query("p1_checked_clean", f"SELECT source_id, media_key FROM {_CHECKED} c WHERE coalesce({', '.join(_WHY)}) IS NULL")(lambda v: _checked(v)[0].select("source_id", "media_key"))
query(
    "p1_checked_counts",
    "SELECT name, n FROM (" + " UNION ALL ".join([f"SELECT '{k}: {r}' AS name, count(*) FILTER ({k} = '{r}') AS n FROM {_CHECKED} c" for k, rs in parse.REASONS.items() for r in rs]
    + [f"SELECT 'rows' AS name, count(*) AS n FROM {_CHECKED} c", f"SELECT 'clean' AS name, count(*) FILTER (coalesce({', '.join(_WHY)}) IS NULL) AS n FROM {_CHECKED} c", f"SELECT 'rejected' AS name, count(*) FILTER (coalesce({', '.join(_WHY)}) IS NOT NULL) AS n FROM {_CHECKED} c"]) + ") t",
)(lambda v: v.spark.createDataFrame(sorted(_checked(v)[2].items()), "name string, n long"))
query("p5_source_profile_key", "SELECT media_key, 'v1|' || url_encode(trim(source_id)) || '|' || url_encode(media_key) || '|mp4|' || url_encode(trim(title) || ' ~*é') AS profile FROM media")(
    lambda v: v.media.select("media_key", c.source_profile_key(F.concat(F.lit(" "), "source_id"), F.col("media_key"), F.lit("mp4"), F.concat(F.trim("title"), F.lit(" ~*é"))).alias("profile"))
)
_TOKENS = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: replace(lower(x), 'ß', 'ss')), lambda x: length(x) >= 2 AND x NOT IN ('official','video','audio','lyrics','lyric','music','hd','4k','1080p','remastered','remaster'))))"
query("p6_title_tokens", f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n, array_to_string({_TOKENS}, ' ') AS core FROM documents")(
    lambda v: v.spark.read.parquet(f"{v.sf_dir}/documents.parquet").select("doc_id", F.size(title_tokens(F.col("text"))).cast("long").alias("n"), normalized_title(F.col("text")).alias("core"))
)
_ACTION = "CASE WHEN position % 9 = 4 OR availability = 'scheduled' THEN 'wait' WHEN availability IN ('private', 'deleted') THEN 'skip' WHEN availability = 'members_only' THEN 'auth_required' ELSE 'download' END"
def _live():
    return F.expr("CASE WHEN position % 9 = 4 THEN ' IS_Upcoming ' END")


query("p7_availability_action", f"SELECT media_key, {_ACTION} AS action FROM media")(lambda v: v.media.select("media_key", c.availability_action(F.col("availability"), _live()).alias("action")))
query("p7_availability_summary", f"SELECT {_ACTION} AS action, count(*) AS n FROM media GROUP BY 1")(lambda v: v.media.groupBy(c.availability_action(F.col("availability"), _live()).alias("action")).agg(F.count("*").alias("n")))
query("f10_usable_items", f"SELECT source_id, media_key FROM media WHERE ({_ACTION}) IN ('download', 'auth_required')")(lambda v: c.usable_items(v.media.withColumn("live_status", _live())).select("source_id", "media_key"))
query(
    "p8_selection_hash",
    """SELECT source_id, sha256(string_agg(b, ',' ORDER BY block)) AS content_hash, CAST(sum(n) AS BIGINT) AS n_items FROM (SELECT source_id, position // 1000 AS block, count(*) AS n,
 sha256(string_agg(sha256(CAST(json_object('media_key', media_key, 'title', title, 'view_count', view_count) AS VARCHAR)), ',' ORDER BY position)) AS b FROM media GROUP BY source_id, position // 1000) t GROUP BY source_id""",
)(lambda v: selection_hash(v.media, "source_id", ["title", "media_key", "view_count"]))
query(
    "p8_plan_hash",
    """SELECT source_id, sha256(CAST(json_object('items', content_hash, 'output_format', 'mp4', 'quality', 'best', 'source', source_id) AS VARCHAR)) AS content_hash FROM (SELECT source_id, sha256(string_agg(b, ',' ORDER BY block)) AS content_hash
 FROM (SELECT source_id, position // 1000 AS block, sha256(string_agg(sha256(CAST(json_object('media_key', media_key, 'title', title) AS VARCHAR)), ',' ORDER BY position)) AS b FROM media GROUP BY source_id, position // 1000) t GROUP BY source_id) u""",
)(lambda v: plan_hash(v.media, "source_id", ["media_key", "title"], v.media.select("source_id").distinct().selectExpr("source_id", "source_id AS source", "'mp4' AS output_format", "'best' AS quality")))
_SECRETS = "'Token: ' || CAST(doc_id AS VARCHAR) || ', ' || text"
for _name, _value in (("authorization", "[^\\s,;]+"), ("cookie", "[^\\r\\n]+"), ("token", "[^\\s,;]+"), ("password", "[^\\s,;]+")):
    _SECRETS = f"regexp_replace({_SECRETS}, '(?i)({_name}\\s*[:=]\\s*)({_value})', '\\1[REDACTED]', 'g')"
query("p12_redact_messages", f"SELECT doc_id, {_SECRETS} AS message FROM documents")(
    lambda v: v.spark.read.parquet(f"{v.sf_dir}/documents.parquet").select("doc_id", redacted(F.concat(F.lit("Token: "), F.col("doc_id").cast("string"), F.lit(", "), "text")).alias("message"))
)
_NAMED = "upper(title) || ' / ' || title || ': x'"
_NAME_SQL = """CASE WHEN upload_date IS NULL THEN '' ELSE strftime(upload_date, '%Y-%m-%d') || ' - ' END || regexp_replace(regexp_replace(regexp_replace(replace(upper(title) || ' / ' || title || ': x', '/', ' - '), '[:]', ' - ', 'g'), '\\s+', ' ', 'g'), '(?:\\s*-\\s*){2,}', ' - ', 'g') || ' [' || media_key || '].mp4'"""
query("p13_output_names", f"SELECT media_key, {_NAME_SQL} AS name FROM media")(lambda v: c.output_names(v.media.withColumn("title", F.expr(_NAMED)), "mp4").select("media_key", "name"))
query("p13_name_collisions", "SELECT source_id, lower(title) AS folded, count(*) AS n FROM media GROUP BY source_id, lower(title) HAVING count(*) > 1")(lambda v: c.name_collisions(v.media.withColumn("name", F.upper("title")), "source_id"))
query("p14_route_folders", "SELECT media_key, CASE WHEN position % 4 = 0 THEN 'Audio' WHEN media_type = 'short' THEN 'Shorts' WHEN media_type = 'stream' THEN 'Streams' ELSE 'Videos' END AS folder FROM media")(
    lambda v: v.media.select("media_key", c.route_folder(F.col("media_type"), F.expr("CASE WHEN position % 4 = 0 THEN 'FLAC' ELSE 'mkv' END")).alias("folder"))
)

# --- order, sets, index ---------------------------------------------------------------------------------------------
query("w1_assign_positions", "SELECT source_id, media_key, row_number() OVER (PARTITION BY source_id ORDER BY position) - 1 AS place FROM media")(
    lambda v: before(v.media.select("source_id", "media_key", "position"), ["source_id", "position"], ["source_id"], out="place").select("source_id", "media_key", "place")
)
query("w2_first_seen", f"SELECT source_id, k AS media_key, min(pos) AS position FROM ({_USABLE}) u GROUP BY source_id, k")(
    lambda v: c.first_seen(c.listing_entries(v.listings).filter("e IS NOT NULL").select("source_id", F.trim("e.id").alias("media_key"), "position"), ["source_id", "media_key"], ["position"])
)
query("u1_union_sources", "SELECT source_id, media_key, position FROM media UNION ALL SELECT source_id || '/shorts', media_key, position FROM media WHERE media_type = 'short'")(
    lambda v: v.media.select("source_id", "media_key", "position").unionByName(v.media.filter("media_type = 'short'").select(F.concat("source_id", F.lit("/shorts")).alias("source_id"), "media_key", "position"))
)
query("u2_shared_media", "SELECT media_key, count(DISTINCT source_id) AS n_sources, min(source_id) AS first_source FROM (SELECT source_id, media_key FROM media UNION ALL SELECT 'src99', media_key FROM media WHERE position % 3 = 0) t GROUP BY media_key")(
    lambda v: c.shared_media(v.media.select("source_id", "media_key").unionByName(v.media.filter("position % 3 = 0").select(F.lit("src99").alias("source_id"), "media_key")))
)
_FIELDS, _STATS = ["title", "duration_seconds", "upload_date", "channel", "availability", "media_type"], ["view_count", "like_count"]
_FLAGS = """SELECT source_id, media_key, position, n = 1 AS added, n > 1 AND m IS DISTINCT FROM pm AS metadata_updated, n > 1 AND s IS NOT NULL AND s IS DISTINCT FROM ps AS stats_updated,
 NOT (n = 1) AND NOT (n > 1 AND m IS DISTINCT FROM pm) AND NOT (n > 1 AND s IS NOT NULL AND s IS DISTINCT FROM ps) AS unchanged FROM (SELECT *, row_number() OVER w AS n, lag(m) OVER w AS pm, last_value(s IGNORE NULLS) OVER (PARTITION BY media_key ORDER BY seq, source_id, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps
 FROM (SELECT 0 AS seq, '' AS source_id, media_key, CAST(-1 AS BIGINT) AS position, concat_ws('|', title, coalesce(CAST(duration_seconds AS VARCHAR), '~'), coalesce(CAST(upload_date AS VARCHAR), '~'), channel, availability, media_type) AS m, CASE WHEN view_count IS NOT NULL OR like_count IS NOT NULL THEN coalesce(CAST(view_count AS VARCHAR), '~') || '|' || coalesce(CAST(like_count AS VARCHAR), '~') END AS s FROM scan1
 UNION ALL SELECT 1, source_id, media_key, position, concat_ws('|', title, coalesce(CAST(duration_seconds AS VARCHAR), '~'), coalesce(CAST(upload_date AS VARCHAR), '~'), channel, availability, media_type), CASE WHEN view_count IS NOT NULL OR like_count IS NOT NULL THEN coalesce(CAST(view_count AS VARCHAR), '~') || '|' || coalesce(CAST(like_count AS VARCHAR), '~') END FROM scan2) u WINDOW w AS (PARTITION BY media_key ORDER BY seq, source_id, position)) t WHERE seq = 1"""
query("w3_scan_row_flags", _FLAGS)(lambda v: i.scan_row_flags(v.scan1, v.scan2, _FIELDS, _STATS))
_MISSING = "SELECT s1.source_id, s1.media_key FROM scan1 s1 JOIN scans c ON c.source_id = s1.source_id AND c.complete WHERE NOT EXISTS (SELECT 1 FROM scan2 s2 WHERE s2.source_id = s1.source_id AND s2.media_key = s1.media_key)"
query("j3_missing_members", _MISSING)(lambda v: i.missing_members(v.scan1.select("source_id", "media_key"), v.scan2, v.scans))
query(
    "a9_scan_diff_summary",
    f"""SELECT f.source_id, count(*) AS item_count, count(*) FILTER (added) AS added, count(*) FILTER (metadata_updated) AS metadata_updated, count(*) FILTER (stats_updated) AS stats_updated, count(*) FILTER (unchanged) AS unchanged,
 (SELECT count(*) FROM ({_MISSING}) g WHERE g.source_id = f.source_id) AS missing FROM ({_FLAGS}) f GROUP BY f.source_id""",
)(lambda v: i.scan_diff_summary(i.scan_row_flags(v.scan1, v.scan2, _FIELDS, _STATS), i.missing_members(v.scan1.select("source_id", "media_key"), v.scan2, v.scans)))
query(
    "b1_upsert_sources",
    "SELECT 'youtube' AS platform, 'playlist' AS kind, source_id AS source_key, CASE WHEN source_id < 'src15' THEN 'new/' ELSE 'old/' END || source_id AS url, CASE WHEN source_id < 'src15' AND source_id <> 'src0' THEN 'T2' WHEN source_id > 'src12' OR source_id = 'src0' THEN CASE WHEN source_id = 'src0' THEN NULL ELSE 'T1' END END AS title FROM scans",
)(
    lambda v: i.upsert_sources(
        v.scans.filter("source_id > 'src12'").selectExpr("'youtube' AS platform", "'playlist' AS kind", "source_id AS source_key", "'old/' || source_id AS url", "'T1' AS title"),
        v.scans.filter("source_id < 'src15'").selectExpr("'youtube' AS platform", "'playlist' AS kind", "source_id AS source_key", "'new/' || source_id AS url", "CASE WHEN source_id <> 'src0' THEN 'T2' END AS title"),
    )
)
query(
    "b2_upsert_media",
    "SELECT media_key, coalesce(a.source_id, b.source_id) AS source_id, coalesce(b.title, a.title) AS title, coalesce(b.availability, a.availability) AS availability FROM scan1 a FULL JOIN (SELECT media_key, source_id, title, availability FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY source_id DESC, position DESC) AS n FROM scan2) t WHERE n = 1) b USING (media_key)",
)(lambda v: i.upsert_media(v.scan1, v.scan2, ["title", "availability"]))
query(
    "b3_upsert_stats",
    "SELECT media_key, CASE WHEN b.k IS NULL THEN a.view_count ELSE b.view_count END AS view_count, CASE WHEN b.k IS NULL THEN a.like_count ELSE b.like_count END AS like_count FROM scan1 a FULL JOIN (SELECT media_key, view_count, like_count, 1 AS k FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY source_id DESC, position DESC) AS n FROM scan2 WHERE view_count IS NOT NULL OR like_count IS NOT NULL) t WHERE n = 1) b USING (media_key)",
)(lambda v: i.upsert_stats(v.scan1, v.scan2, _STATS))
query(
    "b4_upsert_membership",
    """SELECT source_id, media_key, coalesce(b.position, a.position) AS position, CASE WHEN b.position IS NOT NULL THEN TRUE ELSE source_id = 'src0' END AS is_present, CASE WHEN b.position IS NOT NULL THEN DATE '1999-01-01' ELSE DATE '1998-01-01' END AS last_seen
 FROM scan1 a FULL JOIN (SELECT source_id, media_key, max(position) AS position FROM scan2 GROUP BY source_id, media_key) b USING (source_id, media_key)""",
)(lambda v: i.upsert_membership(v.scan1.selectExpr("source_id", "media_key", "position", "TRUE AS is_present", "DATE '1998-01-01' AS last_seen"), v.scan2, v.scans, datetime.date(1999, 1, 1)))
query(
    "b5_mark_refresh",
    """SELECT media_key, group_name, CASE WHEN m.media_key IS NOT NULL AND position % 5 = 0 THEN 'ok' ELSE r.status END AS status, CASE WHEN m.media_key IS NOT NULL AND position % 5 = 0 THEN DATE '1998-01-11' ELSE r.expires_at END AS expires_at
 FROM (SELECT media_key, 'statistics' AS group_name, position FROM media WHERE position % 5 = 0 AND position > 10) m FULL JOIN refreshes r USING (media_key, group_name)""",
)(
    lambda v: i.mark_refresh(
        v.refreshes,
        v.media.filter("position % 5 = 0 AND position > 10").selectExpr("media_key", "'statistics' AS group_name", "'ok' AS status", "TIMESTAMP_NTZ '1998-01-01 00:00:00' AS fetched_at", "864000 AS ttl_seconds").unionByName(v.spark.sql("SELECT 'nobody' AS media_key, 'statistics' AS group_name, 'ok' AS status, TIMESTAMP_NTZ '1998-01-01 00:00:00' AS fetched_at, 5 AS ttl_seconds")),
        v.media,
    )
)
query(
    "j1_enrich_metadata",
    """SELECT source_id, media_key, position, CASE WHEN view_count IS NULL AND position % 2 = 0 THEN position ELSE view_count END AS view_count, CASE WHEN view_count IS NULL AND position % 2 = 0 AND position % 4 <> 0 THEN 'N' ELSE channel END AS channel,
 view_count IS NULL AND position % 2 = 0 AS changed FROM media""",
)(lambda v: i.enrich_metadata(v.media.select("source_id", "media_key", "position", "view_count", "channel"), v.media.filter("position % 2 = 0").selectExpr("media_key", "position AS view_count", "CASE WHEN position % 4 = 0 THEN ' ' ELSE ' N ' END AS channel"), {"view_count"}))
query("j2_freshness_due", "SELECT media_key, r.status IS NULL OR r.status <> 'ok' OR r.expires_at IS NULL OR r.expires_at <= DATE '1996-01-01' AS due FROM media LEFT JOIN refreshes r USING (media_key)")(lambda v: i.freshness_due(v.media, v.refreshes, "statistics", datetime.date(1996, 1, 1)))


# --- the same upserts, bucket by bucket -----------------------------------------------------------------------------
def _in_buckets(v, key, rows, changes, apply):
    """A table of ``rows`` in buckets after ``changes``; the batch of the changes runs twice."""
    table = BucketedTable(v.spark, f"{shared_dir(v.spark)}/buckets-{uuid.uuid4().hex}", key, rows.schema, 16)
    table.merge(rows, lambda old, new: old.unionByName(new), 0)
    for _ in range(2):
        table.merge(changes, apply, 1)
    return table.read()


def _sources(v, where, url, title):
    return v.scans.filter(where).selectExpr("'youtube' AS platform", "'playlist' AS kind", "source_id AS source_key", f"{url} AS url", f"{title} AS title")


query("b1_sources_in_buckets")(lambda v: _in_buckets(v, ["platform", "kind", "source_key"], _sources(v, "source_id > 'src12'", "'old/' || source_id", "'T1'"), _sources(v, "source_id < 'src15'", "'new/' || source_id", "CASE WHEN source_id <> 'src0' THEN 'T2' END"), i.upsert_sources))
query("b2_media_in_buckets")(lambda v: _in_buckets(v, ["media_key"], v.scan1.select("media_key", "source_id", "title", "availability"), v.scan2, lambda old, new: i.upsert_media(old, new, ["title", "availability"])))
query("b3_stats_in_buckets")(lambda v: _in_buckets(v, ["media_key"], v.scan1.select("media_key", *_STATS), v.scan2, lambda old, new: i.upsert_stats(old, new, _STATS)))
for _new, _old in (("b1_sources_in_buckets", "b1_upsert_sources"), ("b2_media_in_buckets", "b2_upsert_media"), ("b3_stats_in_buckets", "b3_upsert_stats")):
    ORACLE_SQL[_new] = ORACLE_SQL[_old]
