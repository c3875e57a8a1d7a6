"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import lower_ascii, stored, table

TOKEN = r"[a-z0-9]+"
#: Rules up to which their index is broadcast; a longer list is joined by shuffle.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over ``host + path + rest`` of a url, A-Z lower-cased, with the literal tokens that any match has.

    ``rule`` is the host and path of a domain rule, and null for a free pattern. The domain rule with the longest text wins,
    any of them before a free pattern; among free patterns block wins."""

    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rule: str | None = None


def domain_rule(verdict: str, host_path: str) -> UrlRule:
    """A rule for a host with all its subdomains, and paths that start with the rule's."""
    return UrlRule(rf"^(?:[^/?#]*\.)?{re.escape(host_path)}", verdict, tuple(re.findall(TOKEN, host_path.rpartition("/")[0])), host_path)


DOMAIN_RULES = (domain_rule("allow", "com/"), domain_rule("block", "example.com/en/"), domain_rule("allow", "www.example.com/en/"), domain_rule("block", "net/es/"), domain_rule("block", "net/fr/"))
#: What no domain rule decides: pages of forms, feeds and trackers, by whole tokens; the rest is allowed.
FREE_RULES = (
    UrlRule(r"(?:^|[^a-z0-9])login(?:[^a-z0-9]|$)", "block", ("login",)),
    UrlRule(r"(?:^|[^a-z0-9])signin(?:[^a-z0-9]|$)", "block", ("signin",)),
    UrlRule(r"[?&]utm_source=feed(?:&|#|$)", "block", ("utm", "source", "feed")),
    UrlRule(r"/wp-admin/", "block", ("wp", "admin")),
    UrlRule(r"(?:^|[.])xxx(?:[./]|$)", "block", ("xxx",)),
    UrlRule(r"[?&]sessionid=[0-9a-f]+", "block", ("sessionid",)),
)
RULES = DOMAIN_RULES + FREE_RULES


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest) of a url: the host, A-Z lower-cased, stands after the first ``://``; without one all three are empty."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"(?s)^[^?#]*(.*)$", 1)
    return lower_ascii(host), path, rest


def rule_index(tokens: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """(no, token, pattern, verdict, rule): each rule under that of its literal tokens which the fewest urls have (ties: by code
    point). ``tokens`` holds the distinct tokens of every url; only those that rules name are counted, each partition on its own first."""
    spark = tokens.sparkSession
    rows = [(i, r.pattern, r.verdict, r.rule, list(r.tokens)) for i, r in enumerate(rules)]
    listed = spark.createDataFrame(rows, "no int, pattern string, verdict string, rule string, tokens array<string>")
    named = listed.select("no", "pattern", "verdict", "rule", F.explode("tokens").alias("token"))
    wanted = named.select("token").distinct()
    seen = tokens.join(F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarity = named.join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rarity.groupBy("no").agg(F.min_by(F.struct("token", "pattern", "verdict", "rule"), F.struct("n", "token")).alias("b"))
    return best.select("no", "b.*")


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A url's distinct tokens fetch the rules indexed under them, and only those rules' expressions run on it (rules without
    a literal token run on every url). Null urls and those without ``://`` have an empty host and path and get
    ``default``, as does what no rule fits. Repeated rows stay; an empty table gives no rows; only the url column is read.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path, rest = url_parts(F.col("url"))
    parts = base.select("page_id", host.alias("host"), path.alias("path"), rest.alias("_rest")).withColumn("_row", F.monotonically_increasing_id())
    parts = stored(parts.withColumn("_whole", F.concat("host", lower_ascii(F.concat("path", "_rest")))).withColumn("_exact", F.concat("host", "path", "_rest")))
    tokens = parts.select("_row", "_whole", "_exact", F.explode(F.array_distinct(F.regexp_extract_all("_whole", F.lit(f"({TOKEN})"), 1))).alias("token"))
    literal = tuple(r for r in rules if r.tokens)
    free = tuple(r for r in rules if not r.tokens)
    fits = None
    if literal:
        index = stored(rule_index(tokens.select("token"), literal))
        candidates = tokens.join(F.broadcast(index) if len(literal) <= BROADCAST_RULES else index, "token")
        subject = F.when(F.col("rule").isNotNull(), F.col("_exact")).otherwise(F.col("_whole"))
        fits = candidates.filter(F.regexp_like(subject, F.col("pattern"))).select("_row", "rule", "verdict")
    for r in free:
        hit = parts.filter(F.regexp_like("_exact" if r.rule else "_whole", F.lit(r.pattern))).select("_row", F.lit(r.rule).cast("string").alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits = hit if fits is None else fits.unionByName(hit)
    if fits is None:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rank = F.struct(F.coalesce(F.length("rule"), F.lit(-1)), F.col("verdict") == "block")
    best = fits.groupBy("_row").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("b"))
    return parts.join(best, "_row", "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_FITS = " ".join(f"WHEN regexp_matches(x, '{r.pattern}') THEN '{r.rule}'" for r in sorted(DOMAIN_RULES, key=lambda r: -len(r.rule)))
_RULED = " ".join(f"WHEN rule = '{r.rule}' THEN '{r.verdict}'" for r in DOMAIN_RULES)
_FREE = " OR ".join(f"regexp_matches(w, '{r.pattern}')" for r in FREE_RULES)
QUERIES = {"op4_urls": op4_urls}
ORACLE_SQL = {
    "op4_urls": f"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(s, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(s, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(s, ''), '^[^?#]*(.*)$', 1) AS rest FROM a),
c AS (SELECT page_id, host, path, host || path || rest AS x, host || lower(path || rest) AS w FROM b),
d AS (SELECT *, CASE {_FITS} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {_RULED} WHEN {_FREE} THEN 'block' ELSE 'allow' END AS verdict FROM d"""
}
