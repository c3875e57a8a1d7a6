"""Quality rules as a ledger of failure bits, with versioned policies and ablations. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import WORD, table

#: Rules by bit, on the measurements of one text; a rule fails where its condition holds. Never renumber: ledgers are kept.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
)
#: Policy versions: the names of the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(name for name, _ in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time, however often ``use`` refers to it inside its own lambdas."""
    return F.transform(F.array(value), use).getItem(0)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are compared by XXH64; sorting them with their places finds
    equal ones, so a text of n words takes n log n steps."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))).otherwise(F.array().cast("array<bigint>"))

    def covered(placed: Column) -> Column:
        last = F.size(placed) - 1
        same = lambda k, j: placed[k]["hash"] == placed[j]["hash"]
        again = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(k, F.least(k + 1, last))))
        at = F.transform(again, lambda k: placed[k]["at"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    def count(hashes: Column) -> Column:
        sorted_places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_once(sorted_places, covered))

    return _once(windows, count)


def measurements(text: Column) -> Column:
    """Struct of MEASURES (long) for a text; null counts as empty. Whole texts, code points."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def whole(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words).cast("long").alias("n_repeat_words"))

    in_words = _once(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), whole)
    in_lines = _once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_chars = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")
    return F.struct(in_words.alias("words"), in_lines.alias("lines"), word_chars.alias("word_chars"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))


def _measured(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_measured", measurements(F.col(text_col)))


def _flat(name: str) -> str:
    return f"_measured.{'words.' if name in ('n_words', 'n_repeat_words') else 'lines.' if name in ('n_lines', 'n_dup_lines') else ''}{name}"


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, MEASURES and ``failed``, whose bit i is set where rule i fails. Every rule is evaluated
    once; policies and ablations need no more than this table. Null and empty texts have measurements of zero; rows that
    repeat stay; an empty table gives an empty ledger; other columns of the input play no part."""
    m = _measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", *[F.col(_flat(n)).alias(n) for n in MEASURES])
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0))
    return m.withColumn("failed", bits)


def policy_mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def with_verdict(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Add ``kept``: no rule of the policy has failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: rows it fails, rows that it alone rejects (kept without it), and rows kept by all the rules.
    One count per failure mask, then bit operations on at most 2^rules masks."""
    mask = policy_mask(policy)
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    each = masks.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_alone"), total(F.col("bits") == 0).alias("n_kept"))


def keep_good(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they were. No join and no shuffle; an empty table stays empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), measurements(F.col(text_col)).alias("_measured"))
    fails = F.lit(False)
    for i, (_, cond) in enumerate(RULES):
        if policy_mask(policy) >> i & 1:
            fails = fails | F.expr(re.sub(rf"\b({'|'.join(MEASURES)})\b", lambda m: _flat(m[0]), cond))
    return rows.filter(~fails).select("d.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_verdict(ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.col("failed").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "n_lines", F.col("failed").alias("failed_rules"))


#: The measurements of ``text`` of a relation ``d(doc_id, text)``; also a part of the pipeline's SQL.
MEASURES_SQL = r"""
w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, w.text, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
q AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END)
             + (CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END) AS failed FROM m)"""

QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL = {
    "op10_quality": f"""WITH d AS (SELECT doc_id, text FROM documents), {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed % 4 <> 0 AS base_failed, failed = 0 AS kept, n_lines, CAST(failed AS BIGINT) AS failed_rules FROM q"""
}
