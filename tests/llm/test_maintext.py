"""Main texts of pages whose parts are known, and minimum cuts against all labellings."""

import html
import itertools
import random
import re
import time

import pytest
from marquee.llm import maintext

P = "The quick brown fox jumps over the lazy dog, and then it rests in the sun for a while."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = {
    "plain article": (page(f"<article><h1>Head</h1><p>{P}</p><p>Of.</p></article>"), f"Head\n{P}\nOf."),
    "all around": (
        page(
            f'<header><a href="/">Site</a><p>Slogan of the site.</p></header><nav><ul><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul></nav><div class="cookie-banner">We use cookies. <button>OK</button></div>'
            f'<div class="ad">Buy this great thing now, it is cheap and good.</div><main><article><header><h1>Head</h1></header><p>{P}</p><div class="ad-slot">Sponsored words stand here.</div><p>Second &amp; last&nbsp;one.</p>'
            f'<form action="/s"><label>Your mail</label><input name=m></form></article><section id="comments"><h2>3 Comments</h2><article class="comment"><p>{P} says a reader.</p></article></section></main>'
            f'<aside class="sidebar"><h3>Related</h3><p>{P}</p></aside><footer>&copy; 2024 Site &middot; All rights.</footer><script>var t="<p>no</p>";</script>'
        ),
        f"Head\n{P}\nSecond & last one.",
    ),
    "no article element": (page(f'<div id="top-nav"><a href=1>Home</a> <a href=2>News</a></div><div class="body-text"><h2>Head</h2><p>{P}</p><p>{P} {P}</p></div><div><a href=3>Next</a></div><div class="page-footer">Imprint</div>'), f"Head\n{P}\n{P} {P}"),
    "open elements": (f"<article><h1>Head</h1><p><b>{P}<br><p>Next <a href='x'>link</a> on.<p>Third.</article><footer>Foot", f"Head\n{P}\nNext link on.\nThird."),
    "cut in a tag": (f"<article><p>{P}</p><p>More of it.</p><p cla", f"{P}\nMore of it."),
    "cut in a reference": (f"<article><p>{P}</p><p>More &am", f"{P}\nMore &am"),
    "cut in a script": (f"<article><p>{P}</p></article><script>var t='</p><p>{P}", P),
    "quotes and comments": (page(f'<article><!-- <p>no</p> --><p title="a > b">{P}</p><p title=\'x"y\'>a &lt; b < c</p></article>'), f"{P}\na < b < c"),
    "white space": (page(f"<article><p>  one\n\t two&nbsp;&#160; three  </p><pre>a\n  b</pre></article><!--"), "one two three\na b"),
    "header in layout class": (page(f'<div class="with-sidebar header-wrapper"><article><p>{P}</p></article></div>'), P),
    "hidden": (page(f'<article><p>{P}</p><p style="display: none">gone gone gone</p><div hidden>gone</div></article>'), P),
    "menus only": (page("<nav><a href=1>One</a></nav><footer>Two</footer>"), ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    source, want = CASES[name]
    assert maintext.extract(source) == want


def test_table_of_cases(spark):
    rows = [(i, f"u{i}", s, "x", 1) for i, (s, _) in enumerate(CASES.values())] + [(0, "u0", CASES["plain article"][0], "x", 1), (None, None, CASES["hidden"][0], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in maintext.main_text(df).collect()), key=str)
    texts = [w for _, w in CASES.values()] + [CASES["plain article"][1], CASES["hidden"][1]]
    assert got == sorted(((r[0], r[1], t, len(t)) for r, t in zip(rows, texts)), key=str)
    assert maintext.main_text(df.limit(0)).count() == 0


def test_whole_table(spark):
    """The pages here have one article element; a reading by patterns gives its blocks."""
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in maintext.op11_main_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", re.sub(r"<[^>]*\Z", "", inner[1])) if inner else []
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert got[r.page_id] == "\n".join(b for b in blocks if b), r.page_id


def cost(lean, links, chosen):
    return sum(max(0, -c) if x else max(0, c) for c, x in zip(lean, chosen)) + sum(c for u, v, c in links if chosen[u] != chosen[v])


def test_minimum_cut():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 8)
        lean = [rng.randint(-9, 9) for _ in range(n)]
        links = [(u, v, rng.randint(0, 6)) for u, v in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        best = min(cost(lean, links, c) for c in itertools.product((False, True), repeat=n))
        assert cost(lean, links, maintext.minimum_cut(lean, links)) == best


def test_smoothness_decides():
    """A lone word between paragraphs is content; the same word between links of a list is not."""
    weights = maintext.PRIOR
    between = maintext.parse(page(f"<div><p>{P}</p><p>word</p><p>{P}</p></div>"))
    among = maintext.parse(page("<div>" + "".join(f"<p><a href={i}>link {i}</a></p>" for i in range(3)) + "<p>word</p><p><a href=9>nine</a></p></div>"))
    assert maintext.label(between, weights) == [True] * 3 and not any(maintext.label(among, weights))


def test_long_pages():
    body = "".join(f"<p>{P} {i}</p>" + ('<div class="ad">Buy it.</div>' if i % 3 == 0 else "") for i in range(15000))
    deep = "<div>" * 20000 + f"<p>{P}</p>" + "</div>" * 20000
    begun = time.perf_counter()
    assert maintext.extract(page(f"<article>{body}</article>")).count("\n") == 14999
    assert maintext.extract(page(deep)) == P
    assert maintext.extract("<" * 100000 + '<a "' * 20000 + "<b") is not None
    assert time.perf_counter() - begun < 60


def test_weights(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    w = maintext.learnt_weights(pages)
    assert w == maintext.learnt_weights(pages.repartition(7)) and w[1] > 0 and w[2] < 0
    assert maintext.learnt_weights(pages.limit(0)) == maintext.PRIOR
    assert maintext.learnt_weights(pages.selectExpr("page_id", "url", "'<p>nothing marked</p>' AS html")) == maintext.PRIOR
