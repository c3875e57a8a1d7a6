"""Column functions on text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a title.
STOP_WORDS = ("official", "video", "audio", "lyrics", "lyric", "music", "hd", "4k", "1080p", "remastered", "remaster")


#: What full case folding changes beyond lower case, from Python's own rule: one character each, and those that become several.
_FOLDED = {chr(i): chr(i).casefold() for i in range(128, 0x1E944) if chr(i) == chr(i).lower() != chr(i).casefold()}
_SINGLE = {k: v for k, v in _FOLDED.items() if len(v) == 1}
_SEVERAL = {k: v for k, v in _FOLDED.items() if len(v) > 1}


def fold(c: Column) -> Column:
    """Full case folding: lower case, final sigma and long s as the plain letters, 'ß' as 'ss', ligatures as their letters."""
    low = F.lower(c)
    single = F.translate(low, "".join(_SINGLE), "".join(_SINGLE.values()))
    whole = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _SEVERAL.items(), single)
    plain = F.octet_length(low) == F.length(low)
    return F.when(plain, low).when(~low.rlike(f"[{''.join(_SEVERAL)}]"), single).otherwise(whole)


def clean_text(c: Column) -> Column:
    """Trimmed of white space; blank is null."""
    return F.nullif(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def known_text(c: Column) -> Column:
    """True where the text is neither null nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def title_tokens(title: Column) -> Column:
    """Sorted distinct folded words of two characters or more, without stop words."""
    words = F.transform(F.regexp_extract_all(title, F.lit(r"([\p{L}\p{N}_]+)"), 1), fold)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))))


def normalized_title(title: Column) -> Column:
    """The tokens joined by spaces; empty for none."""
    return F.array_join(title_tokens(title), " ")


def percent_encoded(c: Column) -> Column:
    """UTF-8 percent-encoding of all but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


#: Names whose values are secrets, and what their values are made of.
SECRETS = (("authorization", r"[^\s,;]+"), ("cookie", r"[^\r\n]+"), ("token", r"[^\s,;]+"), ("password", r"[^\s,;]+"))


def redacted(c: Column) -> Column:
    """Secrets after authorization, cookie, token and password replaced."""
    for name, value in SECRETS:
        c = F.regexp_replace(c, rf"(?i)({name}\s*[:=]\s*)({value})", "$1[REDACTED]")
    return c
