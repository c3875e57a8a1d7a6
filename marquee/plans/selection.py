"""Queries over filters, sorts and selections."""

import datetime

from pyspark.sql import functions as F

from marquee.operators import filters as f
from marquee.operators import ranking as k
from marquee.plans.registry import query

ITEM = ["source_id", "media_key", "position", "title", "duration_seconds", "upload_date", "view_count", "like_count"]
_I = ", ".join(ITEM)


def items(df):
    return df.select(*ITEM)


query("f1_metric_above", f"SELECT {_I} FROM media WHERE view_count > 200000")(lambda v: items(v.media.filter(f.metric_above("view_count", 200000))))
query("f1_metric_below", f"SELECT {_I} FROM media WHERE like_count >= 0 AND like_count < 300")(lambda v: items(v.media.filter(f.metric_below("like_count", 300))))
query("f1_metric_between", f"SELECT {_I} FROM media WHERE view_count BETWEEN 100000 AND 150000")(lambda v: items(v.media.filter(f.metric_between("view_count", 100000, 150000))))
query("f2_metric_open_interval", f"SELECT {_I} FROM media WHERE view_count > 100000 AND view_count < 120000")(lambda v: items(v.media.filter(f.metric_open_interval("view_count", 100000, 120000))))
query("f3_duration_bounds", f"SELECT {_I} FROM media WHERE duration_seconds BETWEEN 300 AND 900")(lambda v: items(v.media.filter(f.duration_bounds(300, 900))))
query("f4_date_bounds", f"SELECT {_I} FROM media WHERE upload_date BETWEEN DATE '1994-01-01' AND DATE '1995-06-30'")(lambda v: items(v.media.filter(f.date_bounds(datetime.date(1994, 1, 1), datetime.date(1995, 6, 30)))))
query("f5_title_contains", "SELECT doc_id, n_chars FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), 'strass') OR contains(replace(lower(text), 'ß', 'ss'), 'sse')")(
    lambda v: v.spark.read.parquet(f"{v.sf_dir}/documents.parquet").filter(f.title_contains(" STRAß ", "text") | f.title_contains("ßE", "text")).select("doc_id", "n_chars")
)
_SPEC = f.FilterSpec(views=(50000, None), duration_max=3000, uploaded_after=datetime.date(1993, 1, 1), title="order 1")
query("f6_compound_filter", f"SELECT {_I} FROM media WHERE view_count > 50000 AND duration_seconds <= 3000 AND upload_date >= DATE '1993-01-01' AND contains(lower(title), 'order 1')")(lambda v: items(f.compound_filter(v.media, _SPEC)))
query("f7_where_compare", f"SELECT {_I} FROM media WHERE view_count >= 90000 AND duration_seconds <> 77")(lambda v: items(v.media.filter(f.where_compare("views", ">=", 90000) & f.where_compare("length", "!=", 77.0))))
query("f8_where_text", f"SELECT {_I} FROM media WHERE trim(channel) <> '' AND NOT contains(lower(channel), 'ch1') AND lower(availability) <> 'private'")(lambda v: items(v.media.filter(f.where_text("channel", "!~", "CH1") & f.where_text("status", "!=", "Private"))))
query("f9_where_all", f"SELECT {_I} FROM media WHERE view_count > 1000 AND lower(media_type) = 'short' AND upload_date < DATE '1997-01-01' AND position % 2 = 0")(
    lambda v: items(f.where_all(v.media, [("views", ">", 1000), ("type", "=", "SHORT"), ("uploaded", "<", datetime.date(1997, 1, 1)), "position % 2 = 0"]))
)
query("f11_missing_metadata", f"SELECT {_I} FROM media WHERE view_count IS NULL OR upload_date IS NULL OR channel IS NULL OR trim(channel) = '' OR trim(availability) = '' OR lower(trim(availability)) = 'unknown'")(
    lambda v: items(f.missing_metadata(v.media, f.required_fields(f.FilterSpec(views=(1, None)), "latest") | {"channel", "availability"}))
)
query("f11_missing_counts", "SELECT 'view_count' AS field, count(*) AS n_missing FROM media WHERE view_count IS NULL UNION ALL SELECT 'channel', count(*) FROM media WHERE channel IS NULL OR trim(channel) = '' UNION ALL SELECT 'upload_date', count(*) FROM media WHERE upload_date IS NULL")(
    lambda v: f.missing_counts(v.media, ["view_count", "channel", "upload_date"])
)
query("f12_search_catalog", "SELECT source_id, media_key, number FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS number FROM media) t WHERE contains(lower(title), 'urgent')")(
    lambda v: f.search_catalog(v.media, "URGENT", ["source_id"], ["position"]).select("source_id", "media_key", "number")
)


def _rank_sql(order: str, where: str = "TRUE", then: str = "TRUE") -> str:
    return f"SELECT source_id, media_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {order}) AS rank, count(*) OVER (PARTITION BY source_id) AS size FROM media WHERE {where}) t WHERE {then}"


def keys(df):
    return df.select("source_id", "media_key", "rank")


for _id, _mode, _order in (
    ("k1_sort_most_viewed", "most-viewed", "view_count DESC NULLS LAST, position"), ("k1_sort_least_viewed", "least-viewed", "view_count ASC NULLS LAST, position"), ("k1_sort_most_liked", "most-liked", "like_count DESC NULLS LAST, position"),
    ("k1_sort_least_liked", "least-liked", "like_count ASC NULLS LAST, position"), ("k2_sort_latest", "latest", "upload_date DESC NULLS LAST, position"), ("k2_sort_oldest", "oldest", "upload_date ASC NULLS LAST, position"),
    ("k3_sort_longest", "longest", "duration_seconds DESC NULLS LAST, position"), ("k3_sort_shortest", "shortest", "duration_seconds ASC NULLS LAST, position"), ("k4_sort_title_az", "title-az", "lower(title) ASC NULLS LAST, position"),
    ("k4_sort_title_za", "title-za", "lower(title) DESC NULLS LAST, position"), ("k5_sort_source", "source", "position"),
):
    query(_id, _rank_sql(_order))(lambda v, m=_mode: keys(k.ranked(v.media, m, spread=True)))

query("k9_select_range_spread", _rank_sql("view_count DESC NULLS LAST, position", then="rank >= 41"))(lambda v: keys(k.select_range(v.media, 41, None, "most-viewed", spread=True)))
query("k6_select_all", f"SELECT {_I} FROM media")(lambda v: items(k.collection_query(v.media, spread=True)))
query("k7_select_first", _rank_sql("position", then="rank <= 7"))(lambda v: keys(k.select_first(v.media, 7)))
query("k8_select_last", _rank_sql("upload_date DESC NULLS LAST, position", then="rank > size - 5"))(lambda v: keys(k.select_last(v.media, 5, "latest")))
query("k9_select_range", _rank_sql("view_count DESC NULLS LAST, position", then="rank BETWEEN 11 AND 30"))(lambda v: keys(k.select_range(v.media, 11, 30, "most-viewed")))
query("k10_select_latest_strict", _rank_sql("upload_date DESC NULLS LAST, position", where="upload_date IS NOT NULL", then="rank <= 10"))(lambda v: keys(k.select_dated_strict(v.media.filter("upload_date IS NOT NULL"), 10, "latest")))
query("k11_top_n_by_metric", _rank_sql("like_count DESC NULLS LAST, position", then="rank <= 25"))(lambda v: keys(k.top_n_by_metric(v.media, "most-liked", 25)))
query(
    "k12_collection_query",
    f"SELECT {_I}, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY view_count DESC NULLS LAST, position) AS rank FROM media WHERE view_count > 10000 AND duration_seconds BETWEEN 60 AND 3600 AND lower(media_type) <> 'stream') t WHERE rank <= 20",
)(lambda v: k.collection_query(v.media, f.FilterSpec(views=(10000, None), duration_min=60, duration_max=3600), [("type", "!=", "stream")], "most-viewed", first=20).select(*ITEM, "rank"))
query("k13_source_order_dates", _rank_sql("position DESC", where="view_count > 5000", then="rank <= 12"))(lambda v: keys(k.source_order_dates(v.media, "oldest", 12, f.FilterSpec(views=(5000, None)))))
query(
    "k14_first_matches",
    """SELECT source_id, media_key, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS rank FROM
 (SELECT source_id, media_key, position, CASE WHEN view_count IS NULL AND position % 3 <> 0 THEN position * 1000 ELSE view_count END AS views FROM media) a WHERE views > 150000) t WHERE rank <= 9""",
)(lambda v: keys(k.first_matches(v.media, v.media.filter("position % 3 <> 0").selectExpr("source_id", "media_key", "position * 1000 AS view_count"), f.FilterSpec(views=(150000, None)), 9, {"view_count"})))
query("k15_pick_positions", "SELECT source_id, media_key, ord FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS n FROM media) t JOIN (VALUES (1, CAST(3 AS BIGINT)), (2, 1), (3, 5), (4, 6), (5, 7)) p(o, n) ON t.n = p.n CROSS JOIN LATERAL (SELECT CAST(o AS BIGINT) AS ord) x")(
    lambda v: k.pick_positions(v.media, "3,1,7-5,6").select("source_id", "media_key", "ord")
)
query("k15_unknown_numbers", "SELECT source_id, number FROM (SELECT source_id, count(*) AS size FROM media GROUP BY source_id) t JOIN (VALUES (CAST(1 AS BIGINT)), (700), (100000)) p(number) ON number > size")(lambda v: k.unknown_numbers(v.media, "1,700,100000"))
