"""Text columns to typed values, as Column expressions; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of counts and the zeros that they stand for.
ZEROS = {"": 0, "k": 3, "l": 5, "lakh": 5, "lac": 5, "m": 6, "cr": 7, "crore": 7, "b": 9}


def parse_count(c: Column) -> Column:
    """Exact whole count: digits, an optional fraction and an optional k, l, lakh, lac, m, cr, crore or b. Scaling shifts digits, so no
    rounding can happen; what is not whole or above 2^63 - 1 is null."""
    t = F.trim(c)
    pattern = r"(?i)^(\d+)(?:\.(\d+))?\s*(k|lakh|lac|l|m|crore|cr|b)?$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    zeros = F.element_at(F.create_map(*[F.lit(x) for kv in ZEROS.items() for x in kv]), F.lower(part(3)))
    fraction = F.regexp_replace(part(2), "0+$", "")
    digits = F.regexp_replace(F.concat(part(1), F.rpad(fraction, zeros, "0")), "^0+(?=.)", "")
    whole = t.rlike(pattern) & (F.length(fraction) <= zeros) & (F.length(digits) <= 19)
    return F.when(whole, F.expr("try_cast(0 AS BIGINT)") + digits.try_cast("bigint"))


def parse_duration(c: Column) -> Column:
    """Seconds as double from a number, 90s, 5m, 1.5h, MM:SS (minutes unbounded) or HH:MM:SS."""
    t = F.trim(c)
    single = r"(?i)^(\d+(?:\.\d+)?)\s*(s|m|h)?$"
    unit = F.lower(F.regexp_extract(t, single, 2))
    scale = F.when(unit == "h", 3600.0).when(unit == "m", 60.0).otherwise(1.0)
    p = F.transform(F.split(t, ":"), lambda x: x.try_cast("bigint"))
    two, three = t.rlike(r"^\d+:\d+$"), t.rlike(r"^\d+:\d+:\d+$")
    low = lambda i: F.get(p, F.lit(i)) < 60
    return (
        F.when(t.rlike(single), F.regexp_extract(t, single, 1).try_cast("double") * scale)
        .when(two & low(1), (F.get(p, F.lit(0)) * 60 + F.get(p, F.lit(1))).cast("double"))
        .when(three & low(1) & low(2), (F.get(p, F.lit(0)) * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2))).cast("double"))
    )


def parse_date(c: Column) -> Column:
    """YYYYMMDD or YYYY-MM-DD."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def parse_video_quality(c: Column) -> Column:
    """struct<mode, height, label> of best, lowest or worst, 1080 or 1080p, exact:1080; heights 144 to 16384."""
    t = F.lower(F.trim(c))
    height = F.regexp_extract(t, r"^(?:exact:)?(\d{2,5})p?$", 1).try_cast("int")
    fine = height.between(144, 16384)
    mode = F.when(t == "best", "best").when(t.isin("lowest", "worst"), "lowest").when(fine & t.startswith("exact:"), "exact").when(fine, "at_most")
    label = F.when(mode.isin("best", "lowest"), mode).when(mode == "exact", F.concat(F.lit("exact:"), height.cast("string"), F.lit("p"))).otherwise(F.concat(height.cast("string"), F.lit("p")))
    return F.when(mode.isNotNull(), F.struct(mode.alias("mode"), F.when(mode.isin("exact", "at_most"), height).alias("height"), label.alias("label")))


def parse_audio_quality(c: Column) -> Column:
    """struct<bitrate, label> of best, 0 or 32 to 512 kbps."""
    t = F.lower(F.trim(c))
    rate = F.regexp_extract(t, r"^(\d{2,4})(?:k|kbps)?$", 1).try_cast("int")
    best = t.isin("best", "0")
    return F.when(best | rate.between(32, 512), F.struct(F.when(~best, rate).alias("bitrate"), F.when(best, "best").otherwise(F.concat(rate.cast("string"), F.lit("k"))).alias("label")))


#: The reasons that each sort of text can have.
REASONS = {
    "count": ("empty", "no count", "negative", "not whole", "too large"), "duration": ("empty", "above 59", "negative", "no duration"), "day": ("empty", "no such day", "no date"),
    "video": ("empty", "height out of range", "no quality"), "audio": ("empty", "rate out of range", "no quality"),
}


def _unread(t: Column, *reasons: tuple[Column, str]) -> Column:
    """Why a text can't be read: empty, or the first reason that holds; used where the value is null."""
    out = F.when(t.isNull() | (t == ""), "empty")
    for when, reason in reasons[:-1]:
        out = out.when(when, reason)
    return out.otherwise(reasons[-1][1])


def count_reason(c: Column) -> Column:
    t = F.trim(c)
    number = t.rlike(r"(?i)^-?\d+(?:\.\d+)?\s*(?:k|lakh|lac|l|m|crore|cr|b)?$")
    zeros = F.element_at(F.create_map(*[F.lit(x) for kv in ZEROS.items() for x in kv]), F.lower(F.regexp_extract(t, r"(?i)([a-z]*)$", 1)))
    parts = F.length(F.regexp_replace(F.regexp_extract(t, r"\.(\d+)", 1), "0+$", ""))
    return F.when(parse_count(c).isNull(), _unread(t, (~number, "no count"), (t.startswith("-"), "negative"), (parts > zeros, "not whole"), (F.lit(True), "too large")))


def duration_reason(c: Column) -> Column:
    t = F.trim(c)
    return F.when(parse_duration(c).isNull(), _unread(t, (t.rlike(r"^\d+(?::\d+){1,2}$"), "above 59"), (t.startswith("-"), "negative"), (F.lit(True), "no duration")))


def date_reason(c: Column) -> Column:
    t = F.trim(c)
    return F.when(parse_date(c).isNull(), _unread(t, (t.rlike(r"^(?:\d{8}|\d{4}-\d{2}-\d{2})$"), "no such day"), (F.lit(True), "no date")))


def video_quality_reason(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(parse_video_quality(c).isNull(), _unread(t, (t.rlike(r"^(?:exact:)?\d+p?$"), "height out of range"), (F.lit(True), "no quality")))


def audio_quality_reason(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(parse_audio_quality(c).isNull(), _unread(t, (t.rlike(r"^\d+(?:k|kbps)?$"), "rate out of range"), (F.lit(True), "no quality")))


def normalized(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``df`` with ``value`` and ``reject`` (the raw text where it can't be read; null text is no reject)."""
    out = df.withColumn("value", value)
    return out.withColumn("reject", F.when(F.col("value").isNull() & F.col(column).isNotNull(), F.col(column)))


def reject_counts(df: DataFrame) -> DataFrame:
    """Rows by outcome: ok, empty (null or blank text) or unreadable."""
    outcome = F.when(F.col("value").isNotNull(), "ok").when(F.coalesce(F.trim("reject"), F.lit("")) == "", "empty").otherwise("unreadable")
    return df.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
