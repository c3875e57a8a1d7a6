"""Aligning the tokens of two tokenizers over the same text, window by window between whitespace anchors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import stored, table

#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge bytes.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Id pairs whose corpus count each worker holds; pairs beyond these are joined. Only speed depends on it.
KNOWN_PAIRS = 400_000
#: Windows that a worker keeps, twice over, and the longest of them in tokens. Only speed depends on them.
KEPT_WINDOWS, WINDOW_TOKENS = 200_000, 24
#: Bytes of text that are tokenized together.
PORTION = 1 << 20
#: A letter for each byte, as byte-level vocabularies write them: printable bytes stand for themselves, the others for the letters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _SHOWN} | {256 + i: b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class ByteLevel:
    """Ids of a byte-level vocabulary file, whose merges stand in the order of their ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path) as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in merges]
        if any(vocab[m] != 256 + i for i, m in enumerate(joined)):
            raise ValueError("merges of the vocabulary are not in the order of its ids")
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(_BYTES[ord(c)] for c in t): i for t, i in vocab.items() if i not in special}
        encoding = tiktoken.Encoding("byte-level", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda texts: [encoding.encode_ordinary(f" {t}") for t in texts]
        self.bytes = _by_id(ranks)


class Pieces:
    """Ids of a piece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = lambda texts: model.encode(texts, num_threads=1)
        ids = range(model.get_piece_size())
        self.bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


class Aligner:
    """Both tokenizers of a worker, and the alignments of windows that it has met, by their ids. Ids of b stand behind those of a here."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        tokens = [*self.a.bytes, *self.b.bytes]
        self.first_b = len(self.a.bytes)
        self.lengths, self.marked = np.array([len(x) for x in tokens], np.int64), np.array([x[:1] == b" " for x in tokens])
        numbers = [*range(len(self.a.bytes)), *range(len(self.b.bytes))]
        #: How a token is written inside a side of a group, and as the side's last.
        self.written = [*[b"%d," % i for i in numbers], *[b"%d|" % i for i in numbers[: self.first_b]], *[b"%d;" % i for i in numbers[self.first_b :]]]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _shared(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where tokens of both sides end, and places of the tokens of a and of b that end together. Both sides have the same bytes."""
        end_a, end_b = np.cumsum(self.lengths[a]), np.cumsum(self.lengths[b])
        place = np.searchsorted(end_b, end_a)
        at_a = np.flatnonzero(end_b[place] == end_a)
        return end_a, end_b, at_a, place[at_a]

    def aligned_windows(self, keys: list[bytes]) -> list[bytes]:
        """Groups of windows as text, all at once. A window is its ids of a, then its ids of b."""
        ids = np.frombuffer(b"".join(keys), np.uint32).astype(np.int64)
        is_b = ids >= self.first_b
        a, b = ids[~is_b], ids[is_b]
        end_a, end_b, at_a, at_b = self._shared(a, b)
        group_a, group_b = np.searchsorted(end_a[at_a], end_a), np.searchsorted(end_a[at_a], end_b)
        closes = np.zeros(len(ids), np.int64)
        closes[at_a] = closes[len(a) + at_b] = len(self.lengths)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = list(map(self.written.__getitem__, (np.concatenate([a, b]) + closes)[order].tolist()))
        to = (np.cumsum(np.array(list(map(len, keys)))) // 4).tolist()
        return list(map(b"".join, map(words.__getitem__, map(slice, [0, *to[:-1]], to))))

    def _found(self, keys: list[bytes]) -> list[bytes]:
        found = list(map(self.known.get, keys))
        if None not in found:
            return found
        missing = {k for k, x in zip(keys, found) if x is None}
        here = {k: x for k in missing if (x := self.older.get(k))}
        missing.difference_update(here)
        if missing:
            new = list(missing)
            here.update(zip(new, self.aligned_windows(new)))
        if len(self.known) + len(here) > KEPT_WINDOWS:
            self.older, self.known = self.known, {}
        self.known.update((k, x) for k, x in here.items() if len(k) <= 8 * WINDOW_TOKENS)
        return [x or here[k] for k, x in zip(keys, found)]

    def __call__(self, texts: list[str]) -> list[tuple[int, int, bytes, np.ndarray] | None]:
        """Per text (tokens of a, tokens of b, groups, links), or None if it is empty or the tokens don't give it back."""
        joined = lambda tokens, ids: b"".join(map(tokens.__getitem__, ids))
        out: list[tuple[int, int, bytes, np.ndarray] | None] = [None] * len(texts)
        rows = [(i, a, b) for i, (t, a, b) in enumerate(zip(texts, self.a.encode(texts), self.b.encode(texts))) if t and joined(self.a.bytes, a) == (whole := b" " + t.encode()) == joined(self.b.bytes, b)]
        if not rows:
            return out
        a, b = (np.fromiter(chain.from_iterable(r[side] for r in rows), np.int64) for side in (1, 2))
        b += self.first_b
        end_a, end_b, at_a, at_b = self._shared(a, b)
        # Anchors: shared ends whose next tokens both begin with a space. Texts do so too, so windows never cross from one to the next.
        marked = lambda x, at: np.append(self.marked[x], True)[at + 1]
        anchors = marked(a, at_a) & marked(b, at_b)
        to_a, to_b = at_a[anchors] + 1, at_b[anchors] + 1
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        window = np.arange(len(n_a))
        order = np.argsort(np.concatenate([np.repeat(2 * window, n_a), np.repeat(2 * window + 1, n_b)]), kind="stable")
        ids = np.concatenate([a, b])[order].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(n_a + n_b)).tolist()
        found = self._found(list(map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        links = a[at_a] << 32 | (b[at_b] - self.first_b)
        whole = np.cumsum([len(r[1]) for r in rows])
        windows, linked = (np.searchsorted(x, whole, "right").tolist() for x in (to_a, at_a + 1))
        for (i, x, y), f, t, g, u in zip(rows, [0, *windows], windows, [0, *linked], linked):
            out[i] = len(x), len(y), b"".join(found[f:t])[:-1], links[g:u]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_ALIGNED = "doc_id long, row long, n_a long, n_b long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per row: doc_id, row (its number), n_a, n_b, n_links, groups_sha256, groups (if wanted, else null), and the linked id pairs
    (a << 32 | b) with how often they occur in it.

    Texts are tokenized whole. Where a token of either side that begins with a space begins at the same byte, the text is
    cut into windows, whose alignments workers keep by their ids. A group is a shortest run of tokens whose ends meet; its last
    tokens are linked, so a text has as many links as groups. Null and empty texts, and those that either side's tokens don't
    give back byte by byte, have no tokens. The vocabulary files have to be there on every executor.
    """
    defaults = default_vocabularies() if a_path is None or b_path is None else (None, None)
    paths = a_path or defaults[0], b_path or defaults[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(*paths)
        names = [f.split()[0] for f in _ALIGNED.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.large_string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            ids, numbers, texts = (batch.column(i) for i in range(3))
            sizes = texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
            begin, held = 0, 0
            for end in range(1, len(texts) + 1):
                held += len(sizes[end - 1] or b"")
                if held < PORTION and end < len(texts):
                    continue
                part = [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
                rows = []
                for doc, number, got in zip(ids.slice(begin).to_pylist(), numbers.slice(begin).to_pylist(), align(part)):
                    n_a, n_b, groups, links = got or (0, 0, b"", np.empty(0, np.int64))
                    pairs, times = np.unique(links, return_counts=True)
                    digest = hashlib.sha256(groups).hexdigest() if got else ""
                    rows.append((doc, number, n_a, n_b, len(links), digest, groups.decode() if with_groups else None, pairs, times.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                begin, held = end, 0

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links hold an id pair, and whether no pair with the same id of b has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = stored(pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("p.times").cast("long")).alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_totals(aligned: DataFrame, counts: DataFrame, known: int = KNOWN_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) over a document's links. The ``known`` most frequent pairs are looked up in the tasks; documents
    send only their other pairs to a join. Rows of one document are then added up."""
    spark = aligned.sparkSession
    top = counts.orderBy(F.col("n").desc(), "pair").limit(known).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(top[c].to_numpy()[order]) for c in ("pair", "n", "best")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            offsets = batch.column(1).offsets.to_numpy()
            pairs, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(numbers)), np.diff(offsets))
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            best_sum, count_sum = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            if len(pair):
                np.add.at(count_sum, owner[hit], times[hit] * n[at[hit]])
                np.add.at(best_sum, owner[hit], times[hit] * best[at[hit]])
            rest = np.bincount(owner[~hit], minlength=len(numbers))
            ends = np.concatenate([[0], np.cumsum(rest)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~hit], k)) for x, k in ((pairs, pa.int64()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(best_sum), pa.array(count_sum), *lists], names=["row", "n_best", "count_sum", "pairs", "times"])

    looked = stored(aligned.select("row", "pairs", "times").mapInArrow(work, "row long, n_best long, count_sum long, pairs array<long>, times array<long>"))
    rest = looked.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    joined = rest.join(counts, "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return looked.select("row", "n_best", "count_sum").unionByName(joined).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; see ``align_documents``.

    Documents that repeat, or have no doc_id, give a row each; an empty table gives none; other columns don't matter.
    """
    aligned = stored(align_documents(docs, a_path, b_path, id_col, text_col))
    counts = stored(pair_counts(aligned))
    joined = aligned.select("doc_id", "row", "n_a", "n_b", "n_links", "groups_sha256").join(link_totals(aligned, counts, known), "row")
    return joined.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op13_align": op13_align}
ORACLE_SQL: dict[str, str] = {}
