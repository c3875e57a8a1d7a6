"""Sorts and selections per source. Unknown sorts last, ties keep source order; ranks are windows over one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.functions.text import fold
from marquee.operators.filters import FilterSpec, where_all
from marquee.operators.ordering import before

#: Sort modes with their column and whether it falls.
SORTS = {
    "most-viewed": ("view_count", True), "least-viewed": ("view_count", False), "most-liked": ("like_count", True), "least-liked": ("like_count", False),
    "latest": ("upload_date", True), "oldest": ("upload_date", False), "longest": ("duration_seconds", True), "shortest": ("duration_seconds", False),
    "title-az": ("title", False), "title-za": ("title", True), "source": (None, False),
}


def sort_keys(mode: str) -> list[Column]:
    """Order of a sort mode; the source position decides ties, ascending for every mode."""
    column, down = SORTS[mode]
    if column is None:
        return [F.col("position").asc()]
    c = fold(F.col(column)) if column == "title" else F.col(column)
    return [c.desc_nulls_last() if down else c.asc_nulls_last(), F.col("position").asc()]


def ranked(df: DataFrame, mode: str = "source", per: str = "source_id", spread: bool = False) -> DataFrame:
    """Add ``rank``, from 1 per source in the order of the mode. A window sorts each source in one task; ``spread`` gives the same
    ranks with a source of any size dealt over many tasks, for a table more."""
    if spread:
        keys = sort_keys(mode)
        return before(df, [F.col(per), *keys], [per], out="rank").withColumn("rank", F.col("rank") + 1)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*sort_keys(mode))).cast("long"))


def select_first(df: DataFrame, n: int, mode: str = "source", per: str = "source_id") -> DataFrame:
    """The first n of every source (Spark keeps n per task and source before the shuffle)."""
    _positive(n)
    return ranked(df, mode, per).filter(F.col("rank") <= n)


def select_last(df: DataFrame, n: int, mode: str = "source", per: str = "source_id") -> DataFrame:
    """The last n of every source, all if there are fewer, with their ranks in forward order: the first n of the reverse order (n
    per task and source before the shuffle), numbered down from the source's size."""
    _positive(n)
    column, down = SORTS[mode]
    c = fold(F.col(column)) if column == "title" else F.col(column) if column else None
    back = [] if c is None else [c.asc_nulls_first() if down else c.desc_nulls_first()]
    last = df.withColumn("_back", F.row_number().over(Window.partitionBy(per).orderBy(*back, F.col("position").desc()))).filter(F.col("_back") <= n)
    sizes = df.groupBy(per).agg(F.count("*").alias("_size"))
    return last.join(sizes, per).withColumn("rank", F.col("_size") - F.col("_back") + 1).select(*df.columns, "rank")


def select_range(df: DataFrame, start: int | None, end: int | None, mode: str = "source", per: str = "source_id", spread: bool = False) -> DataFrame:
    """1-based inclusive range; either end may be open; beyond the end is empty."""
    for x in (start, end):
        if x is not None:
            _positive(x)
    if start is not None and end is not None and start > end:
        raise ValueError("a range's start is after its end")
    out = ranked(df, mode, per, spread)
    if start is not None:
        out = out.filter(F.col("rank") >= start)
    return out.filter(F.col("rank") <= end) if end is not None else out


def _positive(n: int) -> None:
    if n < 1:
        raise ValueError("a selection counts from 1")


def select_dated_strict(df: DataFrame, n: int, mode: str) -> DataFrame:
    """Top n by date; an error naming up to three keys if any date is missing."""
    missing = [r["media_key"] for r in df.filter("upload_date IS NULL").select("media_key").limit(4).collect()]
    if missing:
        raise ValueError("upload date is missing for " + ", ".join(missing[:3]) + (" and more" if len(missing) > 3 else ""))
    return select_first(df, n, mode)


def top_n_by_metric(df: DataFrame, shortcut: str, n: int, sort: str | None = None) -> DataFrame:
    """latest, oldest, most-viewed ... N: its sort, then the first N; another explicit sort is an error."""
    if shortcut not in ("latest", "oldest", "most-viewed", "least-viewed", "most-liked", "least-liked"):
        raise ValueError(f"{shortcut} selects nothing")
    if sort is not None and sort != shortcut:
        raise ValueError(f"{shortcut} conflicts with sort {sort}")
    return select_first(df, n, shortcut)


def collection_query(df: DataFrame, spec: FilterSpec = FilterSpec(), clauses: list = (), sort: str = "source", first: int | None = None, last: int | None = None, span: tuple[int | None, int | None] | None = None, spread: bool = False) -> DataFrame:
    """Filter, clauses, sort, then one selection, per source. Filters come before the rank, so they reach the scan."""
    rows = where_all(df.filter(spec.condition()), list(clauses))
    if sum(x is not None for x in (first, last, span)) > 1:
        raise ValueError("choose one selection")
    if first is not None:
        return select_first(rows, first, sort)
    if last is not None:
        return select_last(rows, last, sort)
    return select_range(rows, *span, sort, spread=spread) if span is not None else ranked(rows, sort, spread=spread)


def source_order_dates(df: DataFrame, mode: str, n: int, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Date order by position alone, for sources listed newest first; not with date filters."""
    if spec.uploaded_after or spec.uploaded_before or mode not in ("latest", "oldest"):
        raise ValueError("position stands for dates only without date filters")
    order = F.col("position").asc() if mode == "latest" else F.col("position").desc()
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(order)).cast("long")
    return df.filter(spec.condition()).withColumn("rank", rank).filter(F.col("rank") <= n)


def pick_positions(df: DataFrame, text: str, per: str = "source_id") -> DataFrame:
    """Rows by number, "1,3,5:8" or "5-8": in order of mention (``ord``), a repeated number once, reversed ranges swapped.
    ``unknown_numbers`` tells which numbers a group lacks."""
    numbers = parse_numbers(text)
    spark = df.sparkSession
    picks = spark.createDataFrame(list(enumerate(numbers, 1)), "ord long, rank long")
    return ranked(df, "source", per, spread=True).join(F.broadcast(picks), "rank")


def parse_numbers(text: str) -> list[int]:
    out: list[int] = []
    for part in text.split(","):
        ends = part.strip().replace("-", ":").split(":")
        if not all(e.strip().isdigit() for e in ends) or len(ends) > 2 or any(int(e) < 1 for e in ends):
            raise ValueError(f"{part!r} is no number or range")
        low, high = sorted((int(ends[0]), int(ends[-1])))
        out += [n for n in range(low, high + 1) if n not in out]
    return out


def unknown_numbers(df: DataFrame, text: str, per: str = "source_id") -> DataFrame:
    """(group, number) of picked numbers that a group doesn't have."""
    numbers = df.sparkSession.createDataFrame([(n,) for n in parse_numbers(text)], "number long")
    sizes = df.groupBy(per).agg(F.count("*").alias("_size"))
    return sizes.join(F.broadcast(numbers), F.col("number") > F.col("_size")).select(per, "number")


def first_matches(df: DataFrame, details: DataFrame, spec: FilterSpec, n: int, required: set[str]) -> DataFrame:
    """The first n in source order that match once missing fields are filled in from ``details``."""
    from marquee.operators.index import enrich_metadata

    return select_first(enrich_metadata(df, details, required).drop("changed").filter(spec.condition()), n)
