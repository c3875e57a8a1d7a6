"""From listing documents and user input to catalogue rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from marquee.functions.text import clean_text, fold, percent_encoded

_ENTRY = "id string, title string, url string, webpage_url string, duration string, upload_date string, view_count string, like_count string, comment_count string, channel string, uploader string, channel_id string, uploader_id string, availability string, live_status string, playlist_count string, n_entries string"
_DOCUMENT = "title string, channel string, uploader string, channel_id string, uploader_id string, playlist_count string, n_entries string, entries array<string>"
#: Hosts and channel tabs of the platform.
HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com")
TABS = ("videos", "shorts", "streams", "playlists")


def nonnegative(c: Column, kind: str = "bigint") -> Column:
    """Castable and 0 or more, else null."""
    n = c.try_cast(kind)
    return F.when(n >= 0, n)


def _given(c: Column) -> Column:
    """An empty value counts as absent, as for ``or``; white space does not."""
    return F.nullif(c, F.lit(""))


def derive_media_type(kind: Column, live_status: Column) -> Column:
    live = F.coalesce(clean_text(live_status).isin("is_live", "was_live", "post_live"), F.lit(False))
    return F.when(kind == "channel_shorts", "short").when((kind == "channel_streams") | live, "stream").otherwise("video")


def parse_listings(listings: DataFrame) -> DataFrame:
    """(source_id, kind, document as struct ``d``); ``kind`` defaults to a playlist."""
    kind = F.col("kind") if "kind" in listings.columns else F.lit("playlist")
    return listings.select("source_id", kind.alias("kind"), F.from_json("document", _DOCUMENT).alias("d"))


def listing_entries(listings: DataFrame) -> DataFrame:
    """(source_id, kind, d, position, e): each listed entry; ``e`` is null unless it is an object with an id.

    ``d`` has only the document's names of its channel, so that no row carries the list it stands in.
    """
    parents = F.struct(*[F.col(f"d.{c}").alias(c) for c in ("channel", "uploader", "channel_id", "uploader_id")])
    lists = parse_listings(listings).select("source_id", "kind", parents.alias("d"), F.col("d.entries").alias("entries"))
    each = lists.select("source_id", "kind", "d", F.posexplode("entries").alias("position", "raw"))
    e = F.when(F.startswith("raw", F.lit("{")), F.from_json("raw", _ENTRY))
    parsed = each.select("source_id", "kind", "d", F.col("position").cast("long").alias("position"), e.alias("e"))
    return parsed.withColumn("e", F.when(clean_text(F.col("e.id")).isNotNull(), F.col("e")))


def _entry_url(fallback: Column) -> Column:
    http = lambda c: F.when(clean_text(c).rlike("^https?://"), clean_text(c))
    return F.coalesce(http(F.col("e.webpage_url")), http(F.col("e.url")), fallback)


def explode_listings(listings: DataFrame) -> DataFrame:
    """One row per usable entry, positions counting usable entries in order."""
    key = clean_text(F.col("e.id"))
    parent = lambda a, b: clean_text(F.coalesce(_given(F.col(f"d.{a}")), F.col(f"d.{b}")))
    own = lambda a, b: clean_text(F.coalesce(_given(F.col(f"e.{a}")), F.col(f"e.{b}")))
    rows = listing_entries(listings).filter("e IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("position")).cast("long") - 1
    return rows.select(
        "source_id", place.alias("position"), key.alias("media_key"), F.coalesce(clean_text(F.col("e.title")), F.lit("Unavailable video")).alias("title"),
        _entry_url(F.concat(F.lit("https://www.youtube.com/watch?v="), key)).alias("url"), nonnegative(F.col("e.duration"), "double").alias("duration_seconds"), clean_text(F.col("e.upload_date")).alias("upload_date"),
        nonnegative(F.col("e.view_count")).alias("view_count"), nonnegative(F.col("e.like_count")).alias("like_count"), nonnegative(F.col("e.comment_count")).alias("comment_count"),
        F.coalesce(own("channel", "uploader"), parent("channel", "uploader")).alias("channel"), F.coalesce(own("channel_id", "uploader_id"), parent("channel_id", "uploader_id")).alias("channel_id"),
        F.coalesce(clean_text(F.col("e.availability")), F.lit("unknown")).alias("availability"), derive_media_type(F.col("kind"), F.col("e.live_status")).alias("media_type"),
    )


def listing_audit(listings: DataFrame) -> DataFrame:
    """Per document: title (else its source), reported_count, item_count, skipped_entries."""
    usable = listing_entries(listings).groupBy("source_id").agg(F.count_if(F.col("e").isNotNull()).alias("item_count"), F.count_if(F.col("e").isNull()).alias("skipped_entries"))
    doc = parse_listings(listings).select("source_id", F.coalesce(clean_text(F.col("d.title")), F.col("source_id")).alias("title"), F.coalesce(nonnegative(F.col("d.playlist_count")), nonnegative(F.col("d.n_entries"))).alias("reported_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return doc.join(usable, "source_id", "left").select("source_id", "title", "reported_count", zero("item_count"), zero("skipped_entries"))


def clean_metadata(df: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """Texts trimmed, blank as null; numbers that aren't castable or negative as null (durations as double)."""
    out = {c: clean_text(F.col(c)) for c in texts} | {c: nonnegative(F.col(c), "double" if c.startswith("duration") else "bigint") for c in numbers}
    return df.withColumns(out)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, as one aggregate that is summed before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def playlist_catalog(listings: DataFrame) -> DataFrame:
    """Playlists of each channel's listing, the first entry of an id; a count of 0 gives way to n_entries."""
    key = clean_text(F.col("e.id"))
    count = nonnegative(F.when(F.col("e.playlist_count").try_cast("double") == 0, F.col("e.n_entries")).otherwise(F.coalesce(_given(F.col("e.playlist_count")), F.col("e.n_entries"))))
    rows = listing_entries(listings).filter("e IS NOT NULL").select(
        "source_id", "position", key.alias("playlist_id"), F.coalesce(clean_text(F.col("e.title")), F.concat(F.lit("Playlist "), key)).alias("title"),
        _entry_url(F.concat(F.lit("https://www.youtube.com/playlist?list="), percent_encoded(key))).alias("url"), count.alias("item_count"),
    )
    return first_seen(rows, ["source_id", "playlist_id"], ["position"])


def fill_item_counts(playlists: DataFrame, probes: DataFrame) -> DataFrame:
    """Only missing counts, from probes (playlist_id, probed)."""
    return playlists.join(probes.select("playlist_id", "probed"), "playlist_id", "left").withColumn("item_count", F.coalesce("item_count", nonnegative(F.col("probed")))).drop("probed")


def resolve_sources(urls: DataFrame, column: str = "url") -> DataFrame:
    """platform, kind, source_key, canonical_url, root_url or a reject reason for every row."""
    raw = F.trim(F.col(column))
    handle = raw.rlike(r"^@[^/\s]*$")
    bare = raw.rlike(r"(?i)^(www\.|m\.)?youtube\.com/|^youtu\.be/") & ~F.contains(raw, F.lit("://"))
    full = F.when(handle, F.concat(F.lit("https://www.youtube.com/"), raw)).when(bare, F.concat(F.lit("https://"), raw)).otherwise(raw)
    df = urls.withColumn("_u", full)
    authority = F.regexp_extract("_u", r"^[^:]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))
    path = F.regexp_extract("_u", r"^[^:]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    df = df.withColumns({"_host": host, "_cred": F.contains(authority, F.lit("@")), "_s": segments, "_q": F.regexp_extract("_u", r"\?([^#]*)", 1)})
    s = lambda i: F.get("_s", F.lit(i))
    first = F.lower(s(0))
    value = lambda name: F.nullif(F.trim(F.try_url_decode(F.nullif(F.regexp_extract("_q", rf"(?:^|&){name}=([^&]+)", 1), F.lit("")))), F.lit(""))
    short = F.col("_host") == "youtu.be"
    is_video, watch, listed = first.isin("shorts", "live", "embed", "v"), first == "watch", first == "playlist"
    at = F.startswith(s(0), F.lit("@")) & (F.length(s(0)) > 1)
    named = first.isin("channel", "c", "user") & (F.size("_s") >= 2)
    tail = F.when(at, F.slice("_s", 2, 1000)).when(named, F.slice("_s", 3, 1000))
    tab = F.lower(F.get(tail, F.lit(0)))
    root = F.concat(F.lit("https://www.youtube.com/"), F.when(at, s(0)).otherwise(F.concat_ws("/", s(0), s(1))))
    tabbed = tab.isin(*TABS) & (F.size(tail) == 1)
    known = F.col("_host").isin(*HOSTS) | F.endswith("_host", F.lit(".youtube.com"))
    reject = (
        F.when(raw.isNull() | (raw == ""), "empty").when(~F.lower("_u").rlike("^https?:"), "scheme").when(F.col("_cred"), "credentials").when(~short & ~known, "host")
        .when(short & (F.size("_s") == 0), "no id").when(short, None).when(is_video & (F.size("_s") < 2), "no id").when(is_video, None)
        .when(watch & value("v").isNull(), "no id").when(listed & value("list").isNull(), "no id").when(watch | listed, None)
        .when(~(at | named) | F.size("_s").isNull() | (F.size("_s") == 0), "unrecognized").when((F.size(tail) == 0) | tabbed | tab.isin("featured", "about", "community"), None).otherwise("subpage")
    )
    df = df.withColumn("reject", reject)
    ok = F.col("reject").isNull()
    channel = F.when(tabbed, F.concat(F.lit("channel_"), tab)).otherwise("channel")
    kind = F.when(short | is_video | watch, "video").when(listed, "playlist").otherwise(channel)
    key = F.when(short, s(0)).when(is_video, s(1)).when(watch, value("v")).when(listed, value("list")).when(at, s(0)).otherwise(s(1))
    url = F.when(kind == "video", F.concat(F.lit("https://www.youtube.com/watch?v="), percent_encoded(key))).when(kind == "playlist", F.concat(F.lit("https://www.youtube.com/playlist?list="), percent_encoded(key))).when(kind == "channel", root).otherwise(F.concat(root, F.lit("/"), tab))
    out = {"platform": F.lit("youtube"), "kind": kind, "source_key": key, "canonical_url": url, "root_url": F.when(kind.startswith("channel"), root)}
    return df.select(*urls.columns, *[F.when(ok, c).alias(n) for n, c in out.items()], "reject")


def build_source_catalog(urls: DataFrame, column: str = "url") -> DataFrame:
    """Distinct resolved sources."""
    rows = resolve_sources(urls, column).filter("reject IS NULL")
    return rows.groupBy("platform", "kind", "source_key").agg(F.min("canonical_url").alias("canonical_url"), F.min("root_url").alias("root_url"), F.count("*").alias("n_inputs"))


def expand_channel_tabs(sources: DataFrame, tabs: tuple[str, ...] = ("videos", "shorts", "streams")) -> DataFrame:
    """A channel gives a row per tab; playlists and tabs pass; videos and playlist tabs are no collections."""
    rows = sources.filter(F.col("kind").isin("channel", "playlist", "channel_videos", "channel_shorts", "channel_streams"))
    kinds = F.when(F.col("kind") == "channel", F.array(*[F.lit(f"channel_{t}") for t in tabs])).otherwise(F.array("kind"))
    each = rows.withColumn("_was", F.col("kind")).withColumn("kind", F.explode(kinds))
    url = F.when(F.col("_was") == "channel", F.concat("root_url", F.lit("/"), F.substring("kind", 9, 100))).otherwise(F.col("canonical_url"))
    return each.withColumn("canonical_url", url).drop("_was")


def read_catalog(sources: DataFrame, membership: DataFrame, media: DataFrame, stats: DataFrame) -> DataFrame:
    """Present members of the given sources with their media and, where known, stats; callers order by position, then key."""
    here = membership.filter("is_present").join(sources.select("source_id").distinct(), "source_id")
    return here.join(media, "media_key").join(stats, "media_key", "left")


def availability_action(availability: Column, live_status: Column) -> Column:
    """wait, skip, auth_required or download."""
    value = F.lower(F.trim(F.coalesce(F.nullif(availability, F.lit("")), F.lit("unknown"))))
    live = F.lower(F.trim(F.coalesce(live_status, F.lit(""))))
    return (
        F.when(live.isin("is_upcoming", "upcoming") | value.isin("scheduled", "upcoming"), "wait").when(value.isin("private", "unavailable", "deleted", "removed"), "skip")
        .when(value.isin("needs_auth", "subscriber_only", "premium_only", "members_only"), "auth_required").otherwise("download")
    )


def availability_reason(availability: Column, live_status: Column) -> Column:
    action = availability_action(availability, live_status)
    return F.when(action == "wait", "not available yet").when(F.lower(F.trim(availability)) == "private", "private").when(action == "skip", "unavailable or removed").when(action == "auth_required", "needs signed-in access").otherwise("available")


def usable_items(df: DataFrame) -> DataFrame:
    live = F.col("live_status") if "live_status" in df.columns else F.lit(None).cast("string")
    return df.filter(availability_action(F.col("availability"), live).isin("download", "auth_required"))


def source_profile_key(platform: Column, media_key: Column, output_format: Column, quality: Column) -> Column:
    """v1|platform|key|format|quality, trimmed and percent-encoded; null if a part is empty."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (platform, media_key, output_format, quality)]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return F.when(whole, F.concat_ws("|", F.lit("v1"), *[percent_encoded(p) for p in parts]))


def route_folder(media_type: Column, output_format: Column) -> Column:
    audio = F.lower(output_format).isin("mp3", "m4a", "opus", "flac", "wav")
    return F.when(audio, "Audio").when(media_type == "short", "Shorts").when(media_type == "stream", "Streams").otherwise("Videos")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def _cut(text: Column, size: Column) -> Column:
    """``text`` in ``size`` UTF-8 bytes at most, without a character that the cut would break."""
    left = F.hex(F.substring(F.encode(text, "UTF-8"), F.lit(1), F.greatest(size, F.lit(0))))
    whole = F.regexp_replace(left, "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$", "")
    return F.decode(F.unhex(whole), "UTF-8")


_EDGE = r"^[ .-]+|[ .-]+$"


def safe_component(value: Column, most: Column | int, fallback: str = "Untitled", plain: bool = False) -> Column:
    """One path component: composed, invalid characters as dashes, device names prefixed, cut to ``most`` UTF-8 bytes. ``plain``: the value
    is ASCII, so there is nothing to compose."""
    c = F.regexp_replace(value if plain else _composed(value), r'[<>:"/\\|?*\x00-\x1f]', " - ")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"(?:\s*-\s*){2,}", " - ")
    c = F.regexp_replace(c, _EDGE, "")
    c = F.when(c == "", fallback).otherwise(c)
    device = F.upper(F.split(c, r"\.").getItem(0)).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    c = F.when(device, F.concat(F.lit("_"), c)).otherwise(c)
    size = F.lit(most) if isinstance(most, int) else most
    c = F.when(F.octet_length(c) > size, _cut(c, size)).otherwise(c)
    c = F.regexp_replace(c, r"[ .-]+$", "")
    return F.when(c == "", fallback).otherwise(c)


def output_names(df: DataFrame, extension: str, most: int = 220) -> DataFrame:
    """Add ``name``: ``[date - ]title [key].ext`` in ``most`` bytes, the key and what follows whole. Only rows with characters beyond ASCII
    go through Python, which composes them."""
    plain = F.coalesce((F.octet_length("title") == F.length("title")) & (F.octet_length("media_key") == F.length("media_key")), F.lit(False))
    prefix = F.coalesce(F.concat(F.date_format("upload_date", "yyyy-MM-dd"), F.lit(" - ")), F.lit(""))

    def named(rows: DataFrame, ascii_only: bool) -> DataFrame:
        ready = rows.withColumn("_id", safe_component(F.col("media_key"), 80, "unknown-id", ascii_only)).withColumn("_prefix", prefix)
        fixed = F.octet_length(F.concat("_prefix", F.lit("["), "_id", F.lit(f"].{extension}")))
        ready = ready.withColumn("_title", safe_component(F.col("title"), F.lit(most) - fixed - 1, plain=ascii_only))
        return ready.withColumn("name", F.concat("_prefix", "_title", F.lit(" ["), "_id", F.lit(f"].{extension}"))).drop("_id", "_prefix", "_title")

    return named(df.filter(plain), True).unionByName(named(df.filter(~plain), False))


def name_collisions(named: DataFrame, folder: str) -> DataFrame:
    """(folder, name, n) of names, folded as file systems do, that several rows of a folder get."""
    return named.groupBy(folder, fold(F.col("name")).alias("folded")).agg(F.count("*").alias("n")).filter("n > 1")


def shared_media(rows: DataFrame) -> DataFrame:
    """One row per media key with the number of sources that list it, and the first of them by code point."""
    return rows.groupBy("media_key").agg(F.count_distinct("source_id").alias("n_sources"), F.min("source_id").alias("first_source"))
