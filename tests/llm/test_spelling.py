"""Spelling variants against a plain reading of their definition."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from marquee.llm import spelling

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(w):
    for i in range(len(w) + 1):
        yield w[:i] + w[i + 1 :] if i < len(w) else w
        for c in ALPHABET:
            yield w[:i] + c + w[i:]
            yield w[:i] + c + w[i + 1 :]


def brute_near(words):
    return {w: {x for x in edits(w) if x in words and x != w} for w in words}


def brute(rows):
    words = brute_words(rows)
    near, form = brute_near(words), {}
    for w, xs in near.items():
        if xs:
            best = min(xs, key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_as_defined(spark):
    rows = [(1, "Wonderful wonderful WONDERFUL " * 40), (2, "wonderfull wonderfull wondrful wondrful wonderful"), (3, None), (4, ""), (None, "wonderful Éléphants éléphants xonderful xonderful"),
            (5, "élephants élephants aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa short short"), (5, "zwonderful zwonderful wonderfu wonderfu onderful onderful"), (6, "q" * 400 + " " + "q" * 400 + " " + "q" * 401 + " " + "q" * 401),
            (7, "w×nderful w×nderful ab́cdefgh it's-a-compound-wonderful")] + [(i, "wonderfull wonderfull letters lettres letters lettres") for i in range(8, 90)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    assert got(spelling.spelling_variants(df)) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert len(want) > 1000 and any(r[1] for r in want)
    assert got(spelling.op12_spelling(spark, "/root/testdata/sf0.001")) == want


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.text("abÀ", min_size=7, max_size=10), min_size=1, max_size=60))
def test_links(spark, words):
    found = spelling.one_edit_links(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted(map(tuple, found)) == sorted((w, x) for w, xs in brute_near(words).items() for x in xs)


def test_links_of_words_beyond_the_bits_of_a_number(spark):
    """Words whose depths fit into one number, just do not, and by far do not."""
    words = {}
    for n in (60, 61, 62, 63, 64, 65, 130):
        base = ("abcdéfgh" * 20)[:n]
        for at in (3, n // 2, n - 2):
            words |= dict.fromkeys((base, base[:at] + "z" + base[at + 1 :], base[:at] + base[at + 1 :], base[:at] + "ÿ" + base[at:]), 2)
    df = spark.createDataFrame([(w,) for w in words], "word string")
    links = spelling.one_edit_links(df)
    assert {(r.word, r.near) for r in links.collect()} == {(w, x) for w, xs in brute_near(words).items() for x in xs}


def test_chains_of_forms(spark):
    counts = [("abcdefgh", 5000), ("abcdefg", 300), ("bcdefg", 9), ("abcdef", 2), ("abcdefx", 20), ("abcdxfx", 2)]
    words = spark.createDataFrame(counts, "word string, n long")
    links = spark.createDataFrame([(w, x) for w, xs in brute_near(dict(counts)).items() for x in xs], "word string, near string")
    rows = {r.word: r for r in spelling.spelling_forms(words, links).collect()}
    assert [rows[w].root for w in ("abcdxfx", "abcdefx", "abcdefg", "abcdefgh")] == ["abcdefgh"] * 4
    assert rows["abcdefx"].form == "abcdefg" and rows["abcdefgh"].form is None


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "only once written")]])
def test_no_words(spark, rows):
    assert spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
