"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from marquee.llm.charmodel import Backoff, WordScores, spell
from marquee.llm.common import stored, table

ORDER = 5
#: Documents per language (as expected numbers) that the models are fitted on, those with the least hashes of their id, and on which scores are
#: calibrated, those with the greatest.
FIT_ROWS, CALIBRATION_ROWS = 2000, 400
#: Share of right answers that accepted documents have in calibration.
PRECISION = 0.99
#: Languages up to which their counts are broadcast; more are joined by shuffle.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def learning_rows(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, fit_rows: int, calibration_rows: int) -> DataFrame:
    """(lang, fold, text) of the bounded sample; fold 0 fits, 1 calibrates. Of n rows of a language min(0.8 n, ``fit_rows``) fit and
    min(0.2 n, ``calibration_rows``) calibrate, as expected numbers, so more rows never make a model smaller."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = stored(rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n")))
    if counts.count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    luck = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")), F.lit(1 << 32)).cast("double") / float(1 << 32)
    tagged = rows.select(F.col(lang_col).alias("lang"), luck.alias("luck"), F.col(text_col).alias("text")).join(counts, F.col("lang") == F.col("_lang"))
    fits, calibrates = F.least(F.lit(0.8), fit_rows / F.col("_n")), F.least(F.lit(0.2), calibration_rows / F.col("_n"))
    fold = F.when(F.col("luck") < fits, 0).when(F.col("luck") >= 1 - calibrates, 1)
    return tagged.withColumn("fold", fold).filter("fold is not null").select("lang", "fold", "text")


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): strings of ``order`` symbols, and shorter ones at the start of words, with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                words[lang].update(words_of(text.as_py()))
            for lang, count in words.items():
                grams: Counter = Counter()
                for w, n in count.items():
                    s = spell(w)
                    for i in range(1, len(s)):
                        if i + 1 >= order:
                            grams[s[i + 1 - order : i + 1]] += n
                        else:
                            grams[s[: i + 1]] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(work, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: dict[str, dict[str, int]], langs: list[str], order: int) -> Backoff:
    """One back-off table for all languages: interpolated Kneser-Ney probabilities of every string that any of them has.

    Lower orders count the different symbols before a string; strings at the start of a word, which have none, keep their counts.
    """
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    levels: dict[str, list[dict[str, int]]] = {}
    for lang in langs:
        by: list[Counter] = [Counter() for _ in range(order)]
        for g, n in counts.get(lang, {}).items():
            by[len(g) - 1][g] += n
        for k in range(order - 1, 0, -1):
            for g in by[k]:
                by[k - 1][g[1:]] += 1
        levels[lang] = by
    grams: list[dict[str, list[float]]] = [dict.fromkeys(g for lang in langs for g in levels[lang][k]) for k in range(order)]
    contexts: list[dict[str, list[float]]] = [dict.fromkeys({g[:-1] for g in grams[k]}) for k in range(order)]
    gram_p: list[dict[str, list[float]]] = [{g: [] for g in d} for d in grams]
    weight: list[dict[str, list[float]]] = [{c: [] for c in d} for d in contexts]
    for lang in langs:
        for k in range(order):
            c = levels[lang][k]
            once, twice = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            total, kinds = Counter(), Counter()
            for g, n in c.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            for h in contexts[k]:
                weight[k][h].append(discount * kinds[h] / total[h] if total[h] else 1.0)
            for g in grams[k]:
                below = gram_p[k - 1][g[1:]][-1] if k else 1 / alphabet
                n, t = c.get(g, 0), total[g[:-1]]
                gram_p[k][g].append(((n - discount) / t if n else 0.0) + weight[k][g[:-1]][-1] * below)
    log = lambda d: {g: [math.log(x) for x in v] for g, v in d.items()}
    return Backoff([log(d) for d in gram_p], [log(d) for d in weight], len(langs), -math.log(alphabet))


_SCORERS: dict[str, WordScores] = {}


def entropies(rows: DataFrame, model, key: str) -> DataFrame:
    """(columns of ``rows`` but text, h): cross-entropy per symbol under every language; null where the text is null or has no letter."""
    keep = [c for c in rows.columns if c != "text"]
    kinds = [f for f in rows.schema.fields if f.name != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = WordScores(model.value)
        scorer = _SCORERS[key]
        for b in batches:
            found = []
            for x in b.column(b.num_columns - 1):
                w = words_of(x.as_py() or "")
                if not any(map(str.isalpha, w)):
                    found.append(None)
                    continue
                total = np.zeros(scorer.model.models)
                for i in range(0, len(w), 100_000):
                    rows_ = scorer.rows(w[i : i + 100_000])
                    total += scorer.table[rows_].sum(axis=0)
                found.append((-total / (sum(map(len, w)) + len(w))).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "h"])

    return rows.select(*keep, "text").mapInArrow(work, StructType([*kinds, StructField("h", ArrayType(DoubleType()))]))


def _score(h: np.ndarray, sharpness: float) -> np.ndarray:
    """Share of the best language: 1 / sum over languages of exp(sharpness * (best entropy - entropy))."""
    return 1 / np.exp(-sharpness * (h - h.min(axis=1, keepdims=True))).sum(axis=1)


def calibrate(h: np.ndarray, right: np.ndarray, precision: float = PRECISION) -> tuple[float, float]:
    """(sharpness, threshold): scores that tell the chance of a right answer best, and the least score above which answers reach
    ``precision`` on the calibration rows (above 1 if none do)."""
    if not len(h):
        return 8.0, 0.5
    best = min((2.0**e for e in range(-2, 9)), key=lambda a: -np.log(np.where(right, s := np.clip(_score(h, a), 1e-6, 1 - 1e-6), 1 - s)).mean())
    s = _score(h, best)
    order = np.argsort(-s)
    share = np.cumsum(right[order]) / np.arange(1, len(s) + 1)
    good = np.flatnonzero(share >= precision)
    return best, float(s[order][good[-1]]) if len(good) else 1.1


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, accepted.

    Languages are the values of ``lang_col`` among the rows where ``learn`` holds. The prediction is the language with the lowest
    cross-entropy per symbol of the whole text; ties go to the first by code point. ``score`` is calibrated to the chance
    that it is right; ``accepted`` is false below the score at which answers were right often enough. Texts that are null or
    without a letter give 'und' with score 0, as does every text when nothing can be learned. Repeated rows stay; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    sample = stored(learning_rows(docs, learn, id_col, text_col, lang_col, fit_rows, calibration_rows))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in gram_counts(sample.filter("fold = 0"), order).toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    langs = sorted(counts)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not langs:
        return base.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    model = spark.sparkContext.broadcast(kneser_ney(counts, langs, order))
    key = f"langid-{model._jbroadcast.id() if model._jbroadcast is not None else id(model)}"
    seen = [(r["lang"], r["h"]) for r in entropies(sample.filter("fold = 1"), model, key).collect() if r["h"]]
    h = np.array([x for _, x in seen]).reshape(-1, len(langs))
    right = np.array([langs[int(i)] == lang for i, (lang, _) in zip(h.argmin(axis=1), seen)], bool) if len(h) else np.zeros(0, bool)
    sharpness, threshold = calibrate(h, right)
    scored = entropies(base, model, key)
    low = F.array_min("h")
    name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("h", low).cast("int"))
    share = 1 / F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.exp(-sharpness * (x - low)))
    score = F.when(F.col("h").isNull(), 0.0).otherwise(share)
    return scored.select("doc_id", F.when(F.col("h").isNull(), UNKNOWN).otherwise(name).alias("lang_pred"), score.alias("score"), (F.col("h").isNotNull() & (score >= threshold)).alias("accepted"))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as an empty text."""
    return (F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds).cast("int")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fold_of("doc_id", 5) != 0)
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op8_langid": op8_langid}
ORACLE_SQL: dict[str, str] = {}
