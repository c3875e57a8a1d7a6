import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from marquee.llm import charmodel as C
from marquee.llm import langid as L
from pyspark.sql import functions as F


def kn(words, order):
    """Kneser-Ney by recursion from the definition."""
    counts = [defaultdict(int) for _ in range(order)]
    for w, n in words.items():
        s = C.spell(w)
        for i in range(1, len(s)):
            counts[min(order - 1, i)][s[max(0, i + 1 - order) : i + 1]] += n
    for k in range(order - 1, 0, -1):
        for g in list(counts[k]):
            counts[k - 1][g[1:]] += 1
    alphabet = len({g[-1] for c in counts for g in c}) + 1

    def p(g):
        k = len(g) - 1
        if k < 0:
            return 1 / alphabet
        c = counts[k]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        same = [v for x, v in c.items() if x[:-1] == g[:-1]]
        below = p(g[1:])
        if not same:
            return below
        return max(c.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * below

    return lambda w: sum(math.log(p(C.spell(w)[max(0, i + 1 - order) : i + 1])) for i in range(1, len(w) + 2))


def test_model_equals_recursion():
    words = {"a": Counter("the then there them at that hat".split()), "b": Counter("le la les lait était tel".split())}
    counts = {}
    for lang, ws in words.items():
        grams = Counter()
        for w, n in ws.items():
            s = C.spell(w)
            for i in range(1, len(s)):
                grams[s[max(0, i + 1 - 4) : i + 1]] += n
        counts[lang] = grams
    model = L.kneser_ney(counts, ["a", "b"], 4)
    test = ["the", "lat", "é", "zzz", "that", "", "thenlethat" * 3]
    got = model.score(test)
    for i, lang in enumerate("ab"):
        f = kn(words[lang], 4)
        ours = {g[-1] for g in counts["a"]} | {g[-1] for g in counts["b"]}
        own = len({g[-1] for g in counts[lang]})
        if own == len(ours):
            assert np.allclose(got[:, i], [f(w) for w in test], atol=1e-4)
    probe = ["the" + c for c in "abc"]
    assert (model.score(probe) < 0).all()


def test_probabilities_sum_to_one():
    counts = {"x": Counter()}
    for w in "abba abab baab aab b".split():
        s = C.spell(w)
        for i in range(1, len(s)):
            counts["x"][s[max(0, i - 2) : i + 1]] += 1
    m = L.kneser_ney(counts, ["x"], 3)
    total = sum(math.exp(m.score([w])[0, 0]) for n in range(12) for w in map("".join, __import__("itertools").product("ab", repeat=n)))
    assert 0.5 < total <= 1.0


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = [(90001, None, "en"), (90002, "", "en"), (90003, "123 ²½ _ !!", "de"), (90004, "x", None), (None, "the and of", "en"), (90005, "die und der " * 60000, None)]
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).selectExpr("*", "1 as h", "2 as score")
    out = {r.doc_id: r for r in L.identify(df, L.fold_of("doc_id", 5) != 0).collect()}
    assert len(out) == df.count()
    assert [out[i].lang_pred for i in (90001, 90002, 90003)] == ["und"] * 3 and out[90001].score == 0
    assert out[90005].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())
    held = [(r.lang, out[r.doc_id].lang_pred) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert L.identify(df.limit(0), F.lit(True)).count() == 0
    none = L.identify(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in none.collect()} == {"und"}
