import re

from marquee.llm import urls as U

URLS = [None, "", "no scheme", "://", "http://COM", "http://com/", "http://a.Com/x?y", "https://example.com/en/", "https://sub.example.com/en/1#t", "https://www.example.com/en/9?utm_source=feed", "https://x.www.example.com/en", "https://x.www.example.com/en/z",
        "https://notexample.com/en/1", "https://a.net/es/1", "https://a.net/ES/1", "https://net/fr/", "https://a.net/de/?utm_source=feed", "https://a.net/de/?utm_source=feeder", "https://a.org/Login", "https://a.org/blogin", "http://a.net:80/es/", "x://y://z.com/",
        "http://a.org/wp-admin/x", "http://a.xxx/1", "http://xxx.org/1", "http://a.org?q=/es/", "http://user@b.net/es/ü", "HTTP://Ä.com/", "http://a.org/?SESSIONID=0aF", "http://a.com\n.net/es/", "http://a.org/" + "p/" * 20000]


def brute(url, rules):
    """Every rule on every url."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    s = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"[^/?#]*", s)[0], re.match(r"[^/?#]*([^?#]*)", s)[1]
    rest = s[len(host) + len(path) :]
    host = low(host)
    fit = [r for r in rules if r.rule and (host == r.rule.split("/", 1)[0] or host.endswith("." + r.rule.split("/", 1)[0])) and path.startswith("/" + r.rule.split("/", 1)[1])]
    if fit:
        best = max(fit, key=lambda r: len(r.rule))
        return host, path, best.rule, best.verdict
    free = {r.verdict for r in rules if not r.rule and re.search(r.pattern, host + low(path + rest))}
    return host, path, None, "block" if "block" in free else "allow"


def test_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(5, URLS[5]), (None, URLS[7])]
    rows += [(1000 + r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as rule", "2 as token")
    for rules in (U.RULES, U.DOMAIN_RULES, (*U.RULES, U.UrlRule(r"^[^/]*\d\d", "block", ()))):
        got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in U.judge_urls(df, rules).collect())
        assert got == sorted((str(i), h, p, str(r), v) for i, u in rows for h, p, r, v in [brute(u, rules)])


def test_rarest_token_and_empty(spark):
    df = spark.createDataFrame([("utm",), ("utm",), ("source",), ("feed",), ("feed",)], "token string")
    assert {r["no"]: r.token for r in U.rule_index(df, (U.FREE_RULES[2],)).collect()} == {0: "source"}
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
