import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from marquee.llm import packing as P
from tokenizers import Tokenizer

ODD = [None, "", " ", "a<|endoftext|>b <|startoftext|>", "e ́ É É", "x\x1cy\x85z w", "tab\x0bvt\x0cff", "'s don't I'LL", "漢字かな 123456", "ß ﬁ Σας", "word " * 9000, "q" * 5000]


#: Their composed forms exist in lower case only.
COMPOSED = ["H\u0331adith", "T\u0308est.", "W\u030aord", "Y\u030a", "J\u030cunk,"]


def test_capitals_with_combining_marks():
    spec = open(P.default_tokenizer()).read()
    tok, mine = Tokenizer.from_str(spec), P.WordIds(spec)
    marks = [chr(c) for c in range(0x300, 0x370)]
    words = COMPOSED + [f"{x}{c}{m}{y}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks for x, y in (("", ""), ("q", "N."), ("É", "\u0331"))]
    for w in words:
        assert mine(w.encode()) == array("I", tok.encode(w, add_special_tokens=False).ids).tobytes(), w


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("AHJTWYaéÉß<|.,!-'\u0331\u0308\u030a\u030c\u0301 "), max_size=12))
def test_any_text(text):
    spec = open(P.default_tokenizer()).read()
    assert P._tokenizer(spec)(text.encode()) == array("I", _TOK.encode(text, add_special_tokens=False).ids).tobytes()


_TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_round_trip(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(8000 + i, t) for i, t in enumerate(ODD)] + [(8003, ODD[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as offset")
    packed = P.pack_documents(df, with_ids=True)
    got = packed.collect()
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            p = array("I", ids[at : at + 2048]).tobytes()
            want.append((str(d), at, len(p) // 4, zlib.crc32(p), len(ids), p))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in got) == sorted(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(seqs) <= total / 2048 * 1.1 + 2
    whole = P.sequences(packed).collect()
    assert len(whole) == len(seqs) and all(len(r["ids"]) == 8192 for r in whole) and sum(r.n_tokens for r in whole) == total


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_patterns_hold_everything(hist):
    n, packs = defaultdict(int), 0
    patterns = P.packing_patterns(hist, 64)
    for times, p in patterns:
        assert sum(x * k for x, k in p) <= 64
        packs += times
        for x, k in p:
            n[x] += times * k
    assert dict(n) == hist
    assert len(patterns) <= 3 * len(hist) + 1 and all(len(p) < 12 for _, p in patterns)
    assert packs <= 1.5 * sum(x * k for x, k in hist.items()) / 64 + max([k for x, k in hist.items() if x > 32], default=0) + 2


def test_few_sequences():
    """As few as can be where only few lengths occur."""
    for hist, least in (({600: 1000}, 334), ({100: 1000}, 50), ({700: 300, 500: 100}, 150), ({2048: 3, 1: 5000}, 6), ({1025: 10, 1023: 10}, 10)):
        assert sum(times for times, _ in P.packing_patterns(hist)) == least, hist


def test_equal_lengths_share_sequences(spark):
    rows = [(i, 600, i) for i in range(1000)] + [(2000 + i, 3, i) for i in range(700)]
    got = P.pack_pieces(spark.createDataFrame([(d, 0, n, c) for d, n, c in rows], "doc_id long, start long, length long, ids_crc32 long")).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 1700 and sorted(seqs) == list(range(334))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
