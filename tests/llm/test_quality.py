from collections import Counter

import re
from marquee.llm import quality as Q
from pyspark.sql import functions as F

WS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WS.findall(text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    cov = {i + k for i, t in enumerate(win) if n[t] > 1 for k in range(3)}
    ls = [x for x in (text or "").split("\n") if WS.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_lines": len(ls), "n_dup_lines": len(ls) - len(set(ls)), "n_repeat_words": len(cov)}


TEXTS = [None, "", " \t\n", "a b c", "a b c a b c", "x " * 20001, "one two three\none two three\n\nfour", "é ü b $ # <|>", "\n".join(f"line {i} of many words" for i in range(40)), "a\x0bb\x0cc\rd e"]


def test_measures(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as failed")
    got = Q.ledger(df).collect()
    assert len(got) == len(rows)
    want = sorted(((str(i), *brute(t).values()) for i, t in rows), key=str)
    assert sorted(((str(r.doc_id), *(r[k] for k in brute("")))  for r in got), key=str) == want


def test_policies_and_ablations(spark):
    good = " ".join(f"word{i} text{i * 7}" for i in range(60))
    df = spark.createDataFrame([(1, good), (2, "short"), (3, good + " # # # # # # # # # # # # # # # #"), (4, None), (5, "\n".join(["same line here"] * 30))], "doc_id long, text string")
    kept = lambda p: {r.doc_id for r in Q.with_verdict(Q.ledger(df), p).filter("kept").collect()}
    assert kept("base") == {1, 3} and kept("v2") == {1}
    extra = df.selectExpr("*", "5 as n_words", "6 as _measured", "7 as d", "8 as `a.b`")
    assert [r.doc_id for r in Q.keep_good(extra).collect()] == [1] and Q.keep_good(extra).columns == extra.columns
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert [r.doc_id for r in Q.keep_good(extra.withColumn("N_WORDS", F.lit(0))).collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    a = {r.rule: r for r in Q.ablations(Q.ledger(df), "v2").collect()}
    assert a["symbols"].n_failed == 1 and a["symbols"].n_alone == 1 and a["too_few_words"].n_alone == 2 and a["symbols"].n_kept == 1
    assert Q.ledger(df.limit(0)).count() == 0
