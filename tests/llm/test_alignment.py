"""Token alignment against a plain reading of its definition."""

import hashlib
from collections import Counter

import pytest
from marquee.llm import alignment

TEXTS = [
    None, "", " ", "a  b\n", "Hello world, hello World!", "don't re-tokenize▁this", "naïve café, über größe", "日本語 and \U0001f600\U0001f600 emoji",
    "<|endoftext|> and <s> </s>", "\x00 nul", "tabs\tand\r\nlines   three", "Hello world, hello World!", "x" * 5000, "word " * 3000, "á combining Å ﬁ", "  lead and trail  ", "12345 67 8.90",
]


def brute(rows, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(a_path)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    out, counts = [], Counter()
    for doc_id, text in rows:
        a = t.encode(f" {text or ''}", add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = f" {text or ''}".encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 300 else __import__("itertools").accumulate(map(len, parts))
        ea, eb = list(ends(a_bytes)), list(ends(b_bytes))
        at_b = {e: j for j, e in enumerate(eb)}
        groups, links, i0, j0 = [], [], 0, 0
        for i, e in enumerate(ea):
            if e in at_b:
                j = at_b[e]
                groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                links.append((a[i], b[j]))
                i0, j0 = i + 1, j + 1
        counts.update(links)
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((d, na, nb, ng, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, na, nb, ng, ls, h in out), key=str)


@pytest.mark.parametrize("known", [400_000, 5, 0])
def test_as_defined(spark, known):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (4, "Hello world, hello World!")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row long, pairs string")
    got = sorted((tuple(r) for r in alignment.alignment_digest(df, known=known).collect()), key=str)
    assert got == brute(rows, *alignment.default_vocabularies())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in alignment.op13_align(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], *alignment.default_vocabularies())


def test_groups_read_back(spark):
    df = spark.createDataFrame([(1, "Hello naïve world, hello \U0001f600")], "doc_id long, text string")
    groups = alignment.align_documents(df, with_groups=True).first()["groups"]
    a, b = alignment.ByteLevel(alignment.default_vocabularies()[0]), alignment.Pieces(alignment.default_vocabularies()[1])
    for group in groups.split(";"):
        left, right = group.split("|")
        assert b"".join(a.bytes[int(i)] for i in left.split(",")) == b"".join(b.bytes[int(i)] for i in right.split(","))


def test_empty_table(spark):
    assert alignment.alignment_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_do_not_depend_on_memory(spark, monkeypatch):
    a_path, b_path = alignment.default_vocabularies()
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 2)
    small = alignment.Aligner(a_path, b_path)
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 10**6)
    large = alignment.Aligner(a_path, b_path)
    texts = [t or "" for t in TEXTS]
    whole = large(texts)
    for t, x in zip(texts, whole):
        y = small([t])[0]
        assert (x is None) == (y is None) and (x is None or (x[:3] == y[:3] and x[3].tolist() == y[3].tolist()))
