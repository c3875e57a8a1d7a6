"""Filters on catalogue items. Unknown never matches, negations included."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import fold, known_text
from marquee.operators.ordering import before

METRICS = {"views": "view_count", "likes": "like_count"}
#: Names under which a clause may call a field.
ALIASES = {
    "view": "view_count", "views": "view_count", "view_count": "view_count", "like": "like_count", "likes": "like_count", "like_count": "like_count",
    "duration": "duration_seconds", "length": "duration_seconds", "date": "upload_date", "uploaded": "upload_date", "upload_date": "upload_date", "title": "title",
    "channel": "channel", "uploader": "channel", "availability": "availability", "status": "availability", "type": "media_type", "media_type": "media_type",
}
TEXT_FIELDS = ("title", "channel", "availability", "media_type")


def _known(column: str) -> Column:
    return F.coalesce(F.col(column) >= 0, F.lit(False))


def metric_above(column: str, low: int) -> Column:
    return _known(column) & (F.col(column) > low)


def metric_below(column: str, high: int) -> Column:
    return _known(column) & (F.col(column) < high)


def metric_between(column: str, low: int, high: int) -> Column:
    if low > high:
        raise ValueError("a range's low end is above its high end")
    return _known(column) & F.col(column).between(low, high)


def metric_open_interval(column: str, low: int | None = None, high: int | None = None, between: tuple[int, int] | None = None) -> Column:
    """above and below together, low < high; ``between`` excludes both."""
    if between is not None:
        if low is not None or high is not None:
            raise ValueError("between excludes above and below")
        return metric_between(column, *between)
    if low is not None and high is not None and low >= high:
        raise ValueError("above must be less than below")
    parts = [metric_above(column, low)] if low is not None else []
    parts += [metric_below(column, high)] if high is not None else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def duration_bounds(least: float | None = None, most: float | None = None, column: str = "duration_seconds") -> Column:
    if any(x is not None and x < 0 for x in (least, most)) or (least is not None and most is not None and least > most):
        raise ValueError("durations are 0 or more, the least no longer than the most")
    c = F.col(column)
    return c.isNotNull() & (c >= least if least is not None else F.lit(True)) & (c <= most if most is not None else F.lit(True))


def date_bounds(after: datetime.date | None = None, before: datetime.date | None = None, column: str = "upload_date") -> Column:
    if after is not None and before is not None and after > before:
        raise ValueError("after is later than before")
    c = F.col(column)
    return c.isNotNull() & (c >= F.lit(after) if after is not None else F.lit(True)) & (c <= F.lit(before) if before is not None else F.lit(True))


def title_contains(needle: str, column: str = "title") -> Column:
    if not needle.strip():
        raise ValueError("a title filter needs text")
    return F.coalesce(F.contains(fold(F.col(column)), fold(F.lit(needle.strip()))), F.lit(False))


@dataclass(frozen=True)
class FilterSpec:
    """Bounds that all must hold; None is no bound. views and likes: (above, below); *_between: inclusive."""

    views: tuple[int | None, int | None] | None = None
    likes: tuple[int | None, int | None] | None = None
    views_between: tuple[int, int] | None = None
    likes_between: tuple[int, int] | None = None
    duration_min: float | None = None
    duration_max: float | None = None
    uploaded_after: datetime.date | None = None
    uploaded_before: datetime.date | None = None
    title: str | None = None

    def condition(self) -> Column:
        parts = []
        for name, column in METRICS.items():
            bounds, between = getattr(self, name), getattr(self, f"{name}_between")
            if bounds is not None or between is not None:
                parts.append(metric_open_interval(column, *(bounds or (None, None)), between=between))
        if self.duration_min is not None or self.duration_max is not None:
            parts.append(duration_bounds(self.duration_min, self.duration_max))
        if self.uploaded_after is not None or self.uploaded_before is not None:
            parts.append(date_bounds(self.uploaded_after, self.uploaded_before))
        if self.title is not None:
            parts.append(title_contains(self.title))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def compound_filter(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.filter(spec.condition())


def where_compare(field: str, op: str, value: object) -> Column:
    """field op value on counts, duration and date; null never matches."""
    column = ALIASES[field.lower().replace("-", "_")]
    if column in TEXT_FIELDS or op not in (">", ">=", "<", "<=", "=", "!="):
        raise ValueError(f"{field} {op} is no comparison")
    c, v = F.col(column), F.lit(value)
    test = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "=": c == v, "!=": c != v}[op]
    return c.isNotNull() & test


def where_text(field: str, op: str, value: str) -> Column:
    """= != ~ (contains) !~ on folded text; null and blank never match."""
    column = ALIASES[field.lower().replace("-", "_")]
    if column not in TEXT_FIELDS or op not in ("=", "!=", "~", "!~"):
        raise ValueError(f"{field} {op} is no text test")
    left, right = fold(F.col(column)), fold(F.lit(value))
    test = {"=": left == right, "!=": left != right, "~": F.contains(left, right), "!~": ~F.contains(left, right)}[op]
    return known_text(F.col(column)) & test


def where_all(df: DataFrame, clauses: list[tuple[str, str, object] | str]) -> DataFrame:
    """Rows for which all clauses hold: (field, op, value), or a Spark SQL condition."""
    for c in clauses:
        if isinstance(c, str):
            df = df.filter(c)
            continue
        column = ALIASES.get(c[0].lower().replace("-", "_"))
        if column is None:
            raise ValueError(f"unknown field {c[0]}")
        df = df.filter((where_text if column in TEXT_FIELDS else where_compare)(*c))
    return df


def required_fields(spec: FilterSpec, sort: str) -> set[str]:
    """Columns that a query can't do without."""
    need = set()
    if spec.views or spec.views_between or sort in ("most-viewed", "least-viewed"):
        need.add("view_count")
    if spec.likes or spec.likes_between or sort in ("most-liked", "least-liked"):
        need.add("like_count")
    if spec.duration_min is not None or spec.duration_max is not None or sort in ("longest", "shortest"):
        need.add("duration_seconds")
    if spec.uploaded_after or spec.uploaded_before or sort in ("latest", "oldest"):
        need.add("upload_date")
    return need


def is_missing(column: str) -> Column:
    c = F.col(column)
    if column == "channel":
        return ~known_text(c)
    if column == "availability":
        return ~known_text(c) | (F.lower(F.trim(c)) == "unknown")
    return c.isNull()


def missing_metadata(df: DataFrame, required: set[str]) -> DataFrame:
    """Rows that lack any required field."""
    return df.filter(reduce(lambda a, b: a | b, [is_missing(c) for c in sorted(required)], F.lit(False)))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_missing), in one pass."""
    one = df.agg(*[F.count_if(is_missing(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "n_missing")


def search_catalog(df: DataFrame, term: str, per: list[str], order: list[str]) -> DataFrame:
    """Numbers 1..n per group in order, then the rows whose title contains the term, under their numbers."""
    numbered = before(df, [*per, *order], per, out="number").withColumn("number", F.col("number") + 1)
    return numbered.filter(title_contains(term))
