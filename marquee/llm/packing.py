"""Packing tokenized documents into sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import before, stored, table

LENGTH = 2048
END_ID = 1
#: Words whose ids a worker keeps, twice over: a full table becomes the older one, whose words move on when they are met again. Only
#: speed depends on it.
KEPT_WORDS, KEPT_BYTES = 450_000, 48 << 20


#: A letter for each byte, as byte-level vocabularies write them: printable bytes stand for themselves, the others for the letters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _byte_letters(word: bytes) -> str:
    return word.decode("latin-1").translate(_LETTERS)


def _latin_word(word: bytes) -> bool:
    """Lower-case letters below U+0250 only, composed."""
    w = word.decode()
    return w.isalpha() and w == w.lower() and max(w) < "\u0250" and unicodedata.is_normalized("NFC", w)


def _lowers_alone(word: bytes) -> bool:
    """Whether A-Z of a word can be lower-cased first: nothing follows that a capital and its small letter could compose with differently,
    and no special token, which is not lower-cased, can be in it."""
    return b"<|" not in word and (word.isascii() or not any(map(unicodedata.combining, word.decode())))


class WordIds:
    """Ids of whole texts, word by word: this kind of tokenizer drops white space and never joins what it separates, so a
    word has the same ids everywhere."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        self.encode, self.pieces = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        #: Whether a lower-case Latin word goes to the model as its bytes alone, so that the steps before the model can be left out.
        same = lambda w: tokenizer.encode(w.upper(), add_special_tokens=False).ids == [t.id for t in self.pieces(_byte_letters(w.encode()))]
        self.plain = all(map(same, ("word", "antidisestablishment", "qx")))
        self.latin = self.plain and all(map(same, ("élève", "übergroß"[:-1], "çàéîõñ", "ŏœřž", "æðþ")))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.bytes = 0

    def __call__(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        words = text.split()
        ids = list(map(self.known.get, words))
        if None in ids:
            at = [i for i, x in enumerate(ids) if x is None]
            self._learn({words[i] for i in at})
            for i in at:
                ids[i] = self.known[words[i]]
        return b"".join(ids)

    def _learn(self, words: set[bytes]) -> None:
        """Ids of new words. Letters are lower-cased by the tokenizer anyway, though only after it has composed them, and punctuation
        after a letter or digit is a token of its own, so a word's stem is encoded once for all its forms."""
        if len(self.known) + 2 * len(words) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.older, self.known, self.bytes = self.known, {}, 0
        for w in [w for w in words if w in self.older]:
            self.known[w] = self.older[w]
            words.discard(w)
        parts, new = {}, set()
        for w in words:
            stem = w.lower() if _lowers_alone(w) else w  # letters beyond ASCII stay
            bare = stem.rstrip(b".,!?:;")
            if bare and bare != stem and b"<|" not in w and bare[-1:].isalnum():
                parts[w] = bare, stem[len(bare) :]
            else:
                parts[w] = (stem,)
            new.update(parts[w])
        for w in [w for w in new if w in self.older]:
            self.known[w] = self.older[w]
        new = [w for w in new if w not in self.known]
        if self.plain:
            for w in new:
                if w.isalpha():
                    self.known[w] = array("I", [t.id for t in self.pieces(w.decode())]).tobytes()
                elif self.latin and _latin_word(w):
                    self.known[w] = array("I", [t.id for t in self.pieces(_byte_letters(w))]).tobytes()
            new = [w for w in new if w not in self.known]
        for w, e in zip(new, self.encode([w.decode() for w in new], add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()
        for w, p in parts.items():
            ids = self.known[w] = b"".join(self.known[x] for x in p)
            self.bytes += len(w) + len(ids)


_TOKENIZERS: dict[int, WordIds] = {}


def _tokenizer(spec: str) -> WordIds:
    """One per worker process."""
    key = hash(spec)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordIds(spec)
    return _TOKENIZERS[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): every text's ids and the end id, cut into pieces of ``length`` at most."""
    with open(tokenizer or default_tokenizer()) as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end, step = array("I", [end_id]).tobytes(), 4 * length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(spec.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())
            rows, held = [], 0

            def out():
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 5 + (pa.binary(),))]
                return pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

            for doc_id, text in zip(ids, texts):
                all_ids = encode(text.as_py() or b"") + end
                for at in range(0, len(all_ids), step):
                    piece = all_ids[at : at + step]
                    rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(all_ids) // 4, piece if with_ids else None))
                    held += len(piece)
                if with_ids and held > 16 << 20:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, kinds)


def packing_patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(times, ((length, pieces of it), ...)) of packs that hold every length as often as the histogram says.

    Lengths are placed longest first, each into the shortest packs that have room for it: the pack counts of a pattern
    move, whole or in part, to the pattern with one more length; what finds no room opens packs, each with as many
    pieces as go in. Work and result depend on the number of different lengths, not of documents: a length adds
    three patterns at most, and a pattern has fewer different lengths than the square root of twice its size.
    """
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=-1)
            if room < size:
                each = length // size
                for times, pieces in ((left // each, each), (1, left % each)):
                    if times and pieces:
                        by_room[length - pieces * size].append((times, ((size, pieces),)))
                break
            times, pattern = by_room[room].pop()
            use = min(left, times)
            if times > use:
                by_room[room].append((times - use, pattern))
            last, pieces = pattern[-1]
            more = (*pattern[:-1], (size, pieces + 1)) if last == size else (*pattern, (size, 1))
            by_room[room - size].append((use, more))
            left -= use
    return [p for packs in by_room.values() for p in packs]


def pattern_slots(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, pieces, first_sequence, offset): which ranks of a length fill, so many a sequence, which sequences."""
    used, rows, first = defaultdict(int), [], 0
    for times, pattern in patterns:
        offset = 0
        for size, pieces in pattern:
            rows.append((size, used[size], used[size] + times * pieces, pieces, first, offset))
            used[size] += times * pieces
            offset += size * pieces
        first += times
    return rows


def pack_pieces(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """``pieces`` with sequence_id and offset. The driver sees the length histogram, of ``length`` rows at most; documents find
    their places by their rank among the pieces of equal length."""
    pieces = stored(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = pattern_slots(packing_patterns(histogram, length))
    # So many rows at most: three patterns per length, each with fewer than the square root of 2 * length different lengths.
    seats = F.broadcast(pieces.sparkSession.createDataFrame(slots, "_length long, _from long, _to long, _pieces long, _first long, _offset long"))
    ranked = before(pieces, ["length", "doc_id", "start", "ids_crc32"], ["length"], out="_rank")
    seated = ranked.join(seats, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    place = F.col("_rank") - F.col("_from")
    sequence, offset = F.col("_first") + F.floor(place / F.col("_pieces")), F.col("_offset") + place % F.col("_pieces") * F.col("_length")
    return seated.select(*pieces.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text is an empty one, whose only id is the end id. A text of over ``length`` ids is cut into full sequences and a
    rest; the rests are packed together. Rows that repeat are packed as often; rows without a doc_id too; an empty
    table gives no rows.
    """
    return pack_pieces(token_pieces(docs, tokenizer, length, end_id, id_col, text_col, with_ids), length)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (binary, padded), n_tokens from the rows of ``pack_documents(with_ids=True)``."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    padding = F.concat(*[F.lit(array("I", [pad_id]).tobytes())])
    return rows.select("sequence_id", F.concat(joined, F.unhex(F.repeat(F.hex(padding), (F.lit(length) - F.col("n_tokens")).cast("int")))).alias("ids"), "n_tokens")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_pack": op7_pack}
ORACLE_SQL: dict[str, str] = {}
