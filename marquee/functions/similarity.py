"""Similarity of fingerprints, durations and titles, and what it means for duplicates; Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_similarity(left: Column, right: Column, max_shift: int = 4) -> Column:
    """Best share of equal bits of two arrays of 32-bit words over shifts of one against the other, with at least min(3, lengths) words
    side by side; null if either is empty."""

    def at(shift: Column) -> Column:
        a, b = F.greatest(F.lit(0), shift), F.greatest(F.lit(0), -shift)
        n = F.least(F.size(left) - a, F.size(right) - b)
        differ = F.aggregate(F.zip_with(F.slice(left, a + 1, F.greatest(n, F.lit(0))), F.slice(right, b + 1, F.greatest(n, F.lit(0))), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return F.when(n >= F.least(F.lit(3), F.size(left), F.size(right)), 1 - differ / (32 * n))

    best = F.array_max(F.transform(F.sequence(F.lit(-max_shift), F.lit(max_shift)), at))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.coalesce(best, F.lit(0.0)))


def frame_similarity(left: Column, right: Column, width: int = 16, height: int = 16) -> Column:
    """Mean over paired gray frames (arrays of pixels) of 0.7 times equal brightness and 0.3 times equal falling edges between neighbours
    in a row; the longer list is cut; null if either is empty."""
    pixels, edges = width * height, (width - 1) * height
    inner = F.array(*[F.lit(r * width + c) for r in range(height) for c in range(width - 1)])

    def one(a: Column, b: Column) -> Column:
        light = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x) / (255.0 * pixels)
        falls = lambda f, i: F.get(f, i) > F.get(f, i + 1)
        same = F.size(F.filter(inner, lambda i: falls(a, i) == falls(b, i)))
        return 0.7 * (1 - light) + 0.3 * (same / edges)

    n = F.least(F.size(left), F.size(right))
    each = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), one)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / n)


def duration_similarity(left: Column, right: Column) -> Column:
    big = F.greatest(left, right)
    return F.when((left >= 0) & (right >= 0), F.when(big == 0, 1.0).otherwise(F.least(left, right) / big))


def duration_compatible(left: Column, right: Column) -> Column:
    """Within 5 seconds or 3 % of the longer; unknown passes."""
    near = F.abs(left - right) <= F.greatest(F.lit(5.0), F.greatest(left, right) * 0.03)
    return left.isNull() | right.isNull() | near


def metadata_score(left_tokens: Column, right_tokens: Column, left: Column, right: Column) -> Column:
    """0.75 of the tokens' Jaccard share and 0.25 of the durations' ratio (one half if unknown)."""
    titles = F.coalesce(F.try_divide(F.size(F.array_intersect(left_tokens, right_tokens)), F.size(F.array_union(left_tokens, right_tokens))), F.lit(0.0))
    big = F.greatest(left, right)
    times = F.when(left.isNull() | right.isNull(), 0.5).when(big == 0, 1.0).otherwise(F.least(left, right) / big)
    return titles * 0.75 + times * 0.25


#: Fixed values of the classification.
@dataclass(frozen=True)
class Thresholds:
    audio_same: float = 0.90
    video_same: float = 0.90
    video_different: float = 0.72
    duration_close: float = 0.97
    clearly_different: float = 0.55


def confidence(*values: Column) -> Column:
    """Mean of the known values, each kept within 0 and 1; none known: 0."""
    known = F.filter(F.array(*values), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, v: s + F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))


def classify_pair(left_video: Column, right_video: Column, left_audio: Column, right_audio: Column, audio: Column, video: Column, duration: Column, t: Thresholds = Thresholds()) -> Column:
    """struct<class, confidence> of a pair, from which streams its sides have and how similar they are. Conditions are tried in order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    close = duration.isNull() | (duration >= t.duration_close)
    heard, seen = yes(audio >= t.audio_same), yes(video >= t.video_same)
    both_v, both_a = left_video & right_video, left_audio & right_audio
    sound_fits = (left_audio == right_audio) & (~left_audio | heard)
    known_low = (audio.isNotNull() | video.isNotNull()) & F.coalesce(audio < t.clearly_different, F.lit(True)) & F.coalesce(video < t.clearly_different, F.lit(True))
    out = lambda name, c: F.struct(F.lit(name).alias("class"), c.alias("confidence"))
    half = F.lit(0.5)
    return (
        F.when((left_video != right_video) & heard & close, out("likely_variant", confidence(audio, duration))).when(left_video != right_video, out("unknown", half))
        .when(both_v & seen & close & sound_fits, out("same_media", confidence(video, audio, duration))).when(both_v & heard & yes(video < t.video_different) & close, out("audio_variant", confidence(audio, 1 - video, duration)))
        .when(both_v & (heard | yes(video >= t.video_different)), out("likely_variant", confidence(audio, video, duration))).when(both_v & known_low, out("different", confidence(1 - audio, 1 - video))).when(both_v, out("unknown", half))
        .when(both_a & heard & close, out("same_media", confidence(audio, duration))).when(both_a & yes(audio < t.clearly_different), out("different", confidence(1 - audio))).when(both_a, out("likely_variant", confidence(audio, duration)))
        .otherwise(out("unknown", F.lit(0.25)))
    )


#: Fixed values.
AUDIO_FORMATS = ("mp3", "m4a", "opus", "flac", "wav")


def should_skip(kind: Column, sure: Column, audio: Column, duration: Column, output_format: str, mode: str) -> Column:
    """Whether a pair's class lets its later item be skipped; modes off, safe and audio."""
    if mode == "off":
        return F.lit(False)
    least = 0.90 if mode == "audio" else 0.95
    variant = F.lit(output_format in AUDIO_FORMATS) & F.coalesce(audio >= least, F.lit(False)) & (duration.isNull() | (duration >= 0.97))
    return F.when(kind == "same_media", sure >= 0.90).when(kind == "audio_variant", variant).otherwise(False)
