"""Near-duplicate documents by SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import components, forest, inner_pairs, partnered, stored, table, whole_runs
from marquee.sources.tables import discard

BITS = 64
SEED = 42
#: Bit lengths of the blocks that must agree, one more for each further split of a hot group: a quarter of what is left.
BLOCKS = (16, 12, 9)


def simhash(data: bytes | None, words: int = 3) -> int:
    """Fingerprint of one text: a bit is 1 if it is set in over half the shingles' XXH64 values. No words: 0."""
    w = data.lower().split() if data else []
    if not w:
        return 0
    if len(w) < words:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)))), repeat(SEED)), np.uint64, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row; whole texts, null as no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(x.as_py(), words) for x in b.column(1).cast(pa.large_binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, fp long")


def trie_pairs(codes: np.ndarray, start: np.ndarray, end: np.ndarray, budget: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of codes (uint64, sorted and distinct within each run [start, end)) that differ in ``budget`` bits at most.

    One binary trie per run, whose nodes are ranges of the sorted codes. Pairs of nodes of one depth go down together,
    all of a depth at once; a pair is dropped as soon as its differing bits exceed the budget, and is settled by
    counting the other bits when both nodes hold one code. Bits above ``top`` are the same within a run.
    """
    found_a, found_b = [], []
    keep = end - start > 1
    own = np.stack([start[keep], end[keep]])  # nodes paired with themselves
    two = np.zeros((5, 0), np.int64)  # low a, high a, low b, high b, bits that differ
    for bit in range(top, -1, -1):
        if not own.size and not two.size:
            break
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        cut = lambda lo, hi: hi - (ones[hi] - ones[lo])
        mid, mid_a, mid_b = cut(own[0], own[1]), cut(two[0], two[1]), cut(two[2], two[3])
        new = [np.stack([own[0], mid, mid, own[1], np.ones_like(mid)])]
        for x0, x1, y0, y1, more in ((two[0], mid_a, two[2], mid_b, 0), (mid_a, two[1], mid_b, two[3], 0), (two[0], mid_a, mid_b, two[3], 1), (mid_a, two[1], two[2], mid_b, 1)):
            new.append(np.stack([x0, x1, y0, y1, two[4] + more]))
        two = np.concatenate(new, axis=1)
        two = two[:, (two[1] > two[0]) & (two[3] > two[2]) & (two[4] <= budget)]
        own = np.concatenate([np.stack([own[0], mid]), np.stack([mid, own[1]])], axis=1)
        own = own[:, own[1] - own[0] > 1]
        single = (two[1] - two[0] == 1) & (two[3] - two[2] == 1)
        a, b = two[0, single], two[2, single]
        near = np.bitwise_count(codes[a] ^ codes[b]) <= budget
        found_a.append(a[near])
        found_b.append(b[near])
        two = two[:, ~single]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _key(level: int, path: Column, code: Column) -> Column:
    """A trie's path of rotations and the bits that its codes begin with, as one number."""
    return F.lit(level << 50) + F.shiftleft(path, 40) + F.shiftrightunsigned(code, BITS - sum(BLOCKS[: level + 1]))


def _rotations(rows: DataFrame, level: int) -> DataFrame:
    """Four copies of each code: the bits below the blocks that agree already, rotated by a quarter each time."""
    step, above = BLOCKS[level], sum(BLOCKS[:level])
    rest = BITS - above
    low = F.col("code").bitwiseAND(F.lit(-1 if rest == BITS else (1 << rest) - 1))
    high = F.lit(0).cast("long") if rest == BITS else F.col("code").bitwiseAND(F.lit(-(1 << rest)))
    mask = F.lit(-1 if rest == BITS else (1 << rest) - 1)
    turned = [low] + [F.shiftleft(low, step * k).bitwiseOR(F.shiftrightunsigned(low, rest - step * k)).bitwiseAND(mask) for k in (1, 2, 3)]
    copies = F.explode(F.array(*[F.struct((F.col("path") * 4 + k).alias("path"), high.bitwiseOR(t).alias("code")) for k, t in enumerate(turned)])).alias("c")
    return rows.select("fp", copies).select("fp", "c.*").withColumn("key", _key(level, F.col("path"), F.col("code")))


def trie_links(codes: DataFrame, budget: int = 3, leaf: int = 2048) -> DataFrame:
    """Links (a, b) that connect exactly the distinct codes (column fp) within ``budget`` (3 at most) differing bits, as stars.

    Two codes with three differing bits at most agree on one of four blocks. So there are four tries, each over the codes rotated to
    begin with another block, whose top levels have an error budget of zero: a subtree below such a block is a group, and
    the trie self-join goes on within it. A group of over ``leaf`` codes begins again with the same argument
    on its remaining bits; one that is still larger after the last block is split into pairs of chunks. No group is
    dropped. Groups give a star for each local component, not all pairs.
    """
    if budget > 3:
        raise ValueError("four blocks serve an error budget of 3 at most")
    rows, parts = codes.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("code")), []
    for level in range(len(BLOCKS)):
        rows = _rotations(rows, level)
        hot = stored(rows.groupBy("key").count().filter(F.col("count") > leaf))
        if hot.isEmpty():
            parts.append(rows.select("key", "fp", "code"))
            break
        tagged = rows.join(hot, "key", "left")
        parts.append(tagged.filter("count is null").select("key", "fp", "code"))
        rows = tagged.filter("count is not null")
    else:
        chunks = F.ceil(F.col("count") * 2 / leaf).cast("int")
        own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
        pairs = rows.select("fp", "code", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        parts.append(pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "code"))
    groups = parts[0]
    for p in parts[1:]:
        groups = groups.unionByName(p)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "key"):
            order = np.lexsort((run["code"].view(np.uint64), run["key"]))
            key, code, fp = run["key"][order], run["code"].view(np.uint64)[order], run["fp"][order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            a, b = trie_pairs(code, edge, np.append(edge[1:], len(key)), budget, BITS - 1 - BLOCKS[0])
            if not len(a):
                continue
            top = forest(len(key), a, b)
            moved = np.flatnonzero(top != np.arange(len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[top[moved]])], names=["a", "b"])

    return groups.repartition("key").sortWithinPartitions("key").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    Documents whose fingerprints differ in ``budget`` bits at most are linked; component_id is the least doc_id that links
    reach. Equal fingerprints become one code before any join. Texts without words have fingerprint 0 and link like
    others. Rows without a doc_id are linked by their text; their class is named by the least doc_id in it, and is
    null if it has none. Repeated rows give repeated rows; an empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col))
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = components(trie_links(codes.select("fp"), budget))
    named = codes.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component_id"), "fp")


#: Bits of wide fingerprints, of shingle sets.
WIDE = 512
#: Deviations of a distance beyond which a pair is no longer in doubt, and the wanted share of pairs at the threshold that meet in a trie.
DOUBT, RECALL = 3.5, 0.98
#: One text in so many says which shingles are frequent, if this leaves so many texts at least, and how many shingles are told apart by their
#: counts (three or more). Sets begin with the rarer ones; only speed depends on it.
ONE_IN, TEXTS, FREQUENT = 25, 10_000, 1_000_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct XXH64 values of the shingles; a shorter text is one shingle."""
    w = data.lower().split() if data else []
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(w[i:] for i in range(words)))), repeat(SEED)), np.uint64, len(w) - words + 1))


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``WIDE`` bits, as 64-bit words, each word from the values mixed with another odd factor."""
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        x = hashes[i : i + (1 << 14), None] * _ODD
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def similar_plan(codes: int, similarity: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(tries, bits of their top levels, greatest distance at which a pair may reach the threshold). Sets of Jaccard similarity s have a cosine of 2s / (1 + s) at least, and each bit differs with probability angle / pi."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    top = min(40, max(8, math.ceil(math.log2(codes + 1)) - 2))
    tries = max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** top)))
    return tries, top, math.ceil(WIDE * p + DOUBT * math.sqrt(WIDE * p * (1 - p)))


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of links that connect what all links do, the nearest ones: distance by distance, each round hooks every tree to a lower one."""
    label, kept = np.arange(n), []
    for level in np.unique(d):
        at = np.flatnonzero(d == level)
        while len(at := at[label[a[at]] != label[b[at]]]):
            la, lb = label[a[at]], label[b[at]]
            high, first = np.unique(np.maximum(la, lb), return_index=True)
            kept.append(at[first])
            label[high] = np.minimum(la, lb)[first]
            while (label[label] != label).any():
                label = label[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def similar_links(codes: DataFrame, similarity: float, recall: float = RECALL, leaf: int = 1024) -> DataFrame:
    """(a, b, d): pairs of codes (columns node, code) within the distance at which sets may have the similarity; of what meets in one subtree,
    the nearest pairs that connect the same.

    One binary trie for each of many choices of bits, whose top levels have an error budget of zero; the subtrees below
    are groups, and ``recall`` of the pairs at the threshold meet in one. Seats carry a short part of the code that drops chance
    meetings; only what is left gets its whole code. Groups of over ``leaf`` codes are compared in pairs of chunks.
    """
    tries, top, most = similar_plan(codes.count(), similarity, recall)
    choice = np.stack([np.random.default_rng([29, t]).choice(WIDE - 64, top, replace=False) + 64 for t in range(tries)])
    p = most / WIDE
    short = math.ceil(64 * p + DOUBT * math.sqrt(64 * p * (1 - p)))
    weight = np.uint64(1) << np.arange(top, dtype=np.uint64)

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(code, axis=1, bitorder="little").astype(np.uint64)
                keys = np.stack([bits[:, c] @ weight + (np.uint64(t) << np.uint64(48)) for t, c in enumerate(choice)], axis=1)
                again = lambda x: pa.array(np.repeat(x, tries))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), again(part.column(0).to_numpy()), again(code[:, :8].copy().view(np.int64)[:, 0])], names=["key", "node", "short"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "key", 1 << 16):
            key, stays = run["key"], partnered(run["key"], run["short"].view(np.uint64), short)
            yield pa.RecordBatch.from_arrays([pa.array(key[stays]), pa.array(run["node"][stays])], names=["key", "node"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "key"):
            code, found = np.frombuffer(b"".join(run["code"]), np.uint64).reshape(len(run["key"]), -1), []
            for i, j in inner_pairs(run["key"]):
                d = np.bitwise_count(code[i] ^ code[j]).sum(axis=1, dtype=np.int32)
                near = d <= most
                found.append((i[near], j[near], d[near]))
            a, b, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            kept = nearest_forest(len(code), a, b, d)
            x, y = run["node"][a[kept]], run["node"][b[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d[kept].astype(np.int32))], names=["a", "b", "d"])

    seated = codes.select("node", "code").mapInArrow(seats, "key long, node long, short long").repartition("key").sortWithinPartitions("key")
    near = stored(seated.mapInArrow(meet, "key long, node long"))
    hot = near.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > leaf)
    tagged = near.join(hot, "key", "left")
    chunks = F.ceil(F.col("n") * 2 / leaf).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pairs = tagged.filter("n is not null").select("key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    groups = tagged.filter("n is null").select("key", "node").unionByName(pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node"))
    # Nodes in order, so that reruns choose the same of equally near pairs.
    whole = groups.join(codes.select("node", "code"), "node").repartition("key").sortWithinPartitions("key", "node")
    return whole.mapInArrow(links, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, how often each stands) of those that are frequent in ``texts`` (text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 250):
                sets = [shingle_set(x.as_py(), words) for x in b.column(0).slice(i, 250).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])

    counts = texts.mapInArrow(work, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    got = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], got.column("n").to_numpy()[order]


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets of this similarity share one of them, as the first shingle that they share
    has all others that they share behind it in both."""
    n = len(shingles)
    if not n:
        return shingles
    keys, counts = frequent
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        shingles = shingles[np.argsort(np.where(keys[at] == shingles, counts[at], 0), kind="stable")]
    return shingles[: n - math.ceil(similarity * n - 1e-9) + 1]


def parity(shingles: np.ndarray) -> bytes:
    """One bit for each low part of the hashes, as many as the set has shingles and ``WIDE`` at least: whether an odd number of them ends
    with it. Each shingle that only one of two sets has changes one bit, so the sets differ in as many shingles as bits, or more."""
    bits = max(WIDE, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(marks: np.ndarray, i: np.ndarray, j: np.ndarray, at_once: int = 1 << 24) -> np.ndarray:
    """In how many shingles the sets i and j of ``marks`` (``parity``) differ at least. The longer one of two is folded."""
    length = np.fromiter(map(len, marks), np.int64, len(marks))
    both, out = np.minimum(length[i], length[j]), np.zeros(len(i), np.int64)
    for size in np.unique(both):
        at = np.flatnonzero(both == size)
        for at in np.array_split(at, min(len(at), math.ceil(len(at) * size / at_once))):
            used, k = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(marks[u], np.uint64).reshape(-1, size // 8), axis=0) for u in used])
            out[at] = np.bitwise_count(rows[k[: len(at)]] ^ rows[k[len(at) :]]).sum(axis=1, dtype=np.int64)
    return out


def in_chunks(rows: DataFrame, leaf: int) -> DataFrame:
    """``rows`` (key, node, ...) with own and other: groups of over ``leaf`` rows as pairs of chunks, so that each two rows of a key meet once:
    where their own chunks differ, or in the pair of a chunk with itself."""
    hot = rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > leaf)
    tagged = rows.join(hot, "key", "left")
    chunks = F.ceil(F.col("size") * 2 / leaf).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    columns = [*(c for c in rows.columns if c != "key"), "own", "other"]
    parts = tagged.filter("size is not null").select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    small = tagged.filter("size is null").select("*", F.lit(0).alias("own"), F.lit(0).alias("other")).select("key", *columns)
    return small.unionByName(parts.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *columns))


def fitting_pairs(run: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one key, of different components and of sizes (n) that allow for the similarity."""
    n, component, side = run["n"], run["component"], run["own"]
    for i, j in inner_pairs(run["key"]):
        fit = (component[i] != component[j]) & ((side[i] != side[j]) | (run["other"][i] == side[i]))
        fit &= np.minimum(n[i], n[j]) + 1e-9 >= similarity * np.maximum(n[i], n[j])
        yield i[fit], j[fit]


def has_room(run: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs may reach the similarity, if the shingle where they meet is the first that they share."""
    n, behind = run["n"], run["n"] - run["pos"]
    return np.minimum(behind[i], behind[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9


def not_apart(marks: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs may reach the similarity, as they differ in few enough bits of their ``parity``."""
    least = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9)
    return least_apart(marks, i, j) <= n[i] + n[j] - 2 * least


def prefix_seats(heads: DataFrame, similarity: float | None = None, large: int = 64) -> DataFrame:
    """(key, node, n, component, pos): stored places of the prefixes' shingles that sets (node, n, prefix, component) of different components
    share. With a similarity, those of up to ``large`` sets go if none of these fits by its size and by what stands behind the shingle."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "key", 1 << 16):
            edge = np.flatnonzero(np.concatenate([[True], run["key"][1:] != run["key"][:-1]]))
            several = np.minimum.reduceat(run["component"], edge) != np.maximum.reduceat(run["component"], edge)
            sizes = np.diff(np.append(edge, len(run["key"])))
            stays, sizes = np.repeat(several, sizes), np.repeat(sizes, sizes)
            if similarity is not None:
                small = {c: x[stays & (sizes <= large)] for c, x in run.items()}
                fits = np.zeros(len(small["key"]), bool)
                for i, j in fitting_pairs(small | {c: np.zeros(len(fits), np.int32) for c in ("own", "other")}, similarity):
                    room = has_room(small, i, j, similarity)
                    fits[i[room]] = fits[j[room]] = True
                stays[np.flatnonzero(stays & (sizes <= large))[~fits]] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[stays]) for c in run.values()], names=list(run))

    seats = heads.select("node", "n", "component", F.posexplode("prefix").alias("pos", "key")).select("key", "node", "n", "component", "pos")
    return stored(seats.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "key long, node long, n long, component long, pos int"))


def prefix_pairs(heads: DataFrame, similarity: float, leaf: int = 1024) -> DataFrame:
    """Distinct pairs (a, b) of sets (columns node, n, prefix, component) of different components whose sizes, first shared shingle and number
    of shingles shared by the prefixes allow for the similarity: all pairs of two components that reach it are among them.

    What sets share outside of both prefixes stands behind one prefix. Groups of over ``leaf`` sets are compared in pairs of chunks,
    so that each pair meets once for a shingle. All pairs are listed; ``prefix_links`` gives what connects the same sets.
    """
    share = similarity / (1 + similarity)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "key"):
            node, n, behind = run["node"], run["n"], run["n"] - run["pos"]
            rest = np.ceil(similarity * n - 1e-9) - 1  # behind the prefix
            for i, j in fitting_pairs(run, similarity):
                least = share * (n[i] + n[j]) - 1e-9
                more = least - np.maximum(rest[i], rest[j])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(more), pa.array(np.minimum(behind[i], behind[j]) >= least)], names=["a", "b", "more", "room"])

    near = prefix_seats(heads)
    met = in_chunks(near, leaf).repartition("key").sortWithinPartitions("key").mapInArrow(pairs, "a long, b long, more double, room boolean")
    found = stored(met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("more").alias("more"), F.max("room").alias("room")).filter("room AND shared >= more").select("a", "b"))
    discard(near)
    return found


def prefix_links(heads: DataFrame, similarity: float, sets_of: Callable[[DataFrame], DataFrame], leaf: int = 1024) -> DataFrame:
    """Links (a, b) of sets (columns node, n, prefix, component, parity) that reach the similarity and connect all components that such pairs do.

    Sets that share a shingle of their prefixes meet, and those that their sizes, the place of that shingle and the bits of their parities
    allow to be similar are of one cluster: a forest of each group tells the clusters, whatever the number of pairs in it. Then all pairs of
    a cluster are compared, by their bits first and by their sets (``sets_of``: node, set of given nodes), unless they are connected already.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "key"):
            n, found = run["n"], [(np.zeros(0, np.int64),) * 2]
            for i, j in fitting_pairs(run, similarity):
                room = has_room(run, i, j, similarity)
                i, j = i[room], j[room]
                near = not_apart(run["parity"], n, i, j, similarity)
                found.append((i[near], j[near]))
            top = forest(len(n), *(np.concatenate(x) for x in zip(*found)))
            moved = np.flatnonzero(top != np.arange(len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(run["node"][moved]), pa.array(run["node"][top[moved]])], names=["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "key", 256):
            n = run["n"] = np.fromiter(map(len, run["set"]), np.int64, len(run["key"]))
            marks = [parity(x.view(np.uint64)) for x in run["set"]]
            start, (_, at) = np.cumsum(n) - n, np.unique(np.concatenate(run["set"]), return_inverse=True)
            label, has, a, b = np.unique(run["component"], return_inverse=True)[1], np.zeros(at.max() + 1, bool), [], []
            for i, j in fitting_pairs(run, similarity):
                near = not_apart(marks, n, i, j, similarity)
                i, j = i[near], j[near]
                edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))[: len(i)]
                for x, others in zip(i[edge], np.split(j, edge[1:])):
                    others = others[label[others] != label[x]]
                    if not len(others):
                        continue
                    own, size = at[start[x] : start[x] + n[x]], n[others]
                    has[own] = True
                    begin = np.cumsum(size) - size
                    shared = np.add.reduceat(has[at[np.arange(size.sum()) + np.repeat(start[others] - begin, size)]].astype(np.int64), begin)
                    has[own] = False
                    others = others[shared >= similarity * (n[x] + size - shared)]
                    others = others[np.unique(label[others], return_index=True)[1]]
                    label[np.isin(label, label[others])] = label[x]
                    a += [run["node"][x]] * len(others)
                    b += run["node"][others].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    near = prefix_seats(heads, similarity)
    dealt = stored(in_chunks(near, leaf))
    discard(near)
    # Bits are moved once, with the places that are left.
    marked = dealt.join(heads.select("node", "parity").distinct(), "node").select("key", "node", "n", "component", "pos", "own", "other", "parity")
    met = stored(marked.repartition("key").sortWithinPartitions("key").mapInArrow(candidates, "a long, b long"))
    discard(dealt)
    clusters = stored(components(met).withColumnRenamed("component", "key"))
    sets = sets_of(clusters.select("node"))
    members = clusters.join(heads.select("node", "component").distinct(), "node").select("key", "node", "component")
    found = stored(in_chunks(members, leaf).join(sets, "node").repartition("key").sortWithinPartitions("key", "node").select("key", "node", "component", "own", "other", "set").mapInArrow(links, "a long, b long"))
    discard(met, clusters, sets)
    return found


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: documents link when their sets of ``words``-word shingles have this Jaccard similarity or more.
    See ``similar_classes``."""
    return similar_classes(docs, words, similarity, id_col, text_col).select("doc_id", "component_id")


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, component, component_id) for every row. mark: hash of its text, which tells rows that share an id apart; component names
    its class, also where several classes have the same least id, component_id.

    Equal sets become one code first. Wide SimHash fingerprints propose links by trie self-joins; each code's nearest ones are compared
    by their sets. Pairs that no trie brings together or that were not compared are found by the rare shingles that similar sets share:
    such pairs of different classes are compared until their classes are one, so every link counts and nothing else links. Texts without words are one class. Rows
    without an id or with a repeated one count by their texts; an empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    one_in = max(1, min(ONE_IN, given.count() // TEXTS))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(given.filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text"), words))

    def work(with_set: bool):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 250):
                    part = b.slice(i, 250)
                    sets = [shingle_set(x.as_py(), words) for x in part.column(1).cast(pa.large_binary())]
                    node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
                    lists = lambda arrays: pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64()))
                    more = {"set": lists(sets)} if with_set else {"n": pa.array([len(x) for x in sets], pa.int64()), "code": pa.array([wide_simhash(x).tobytes() for x in sets], pa.binary()), "parity": pa.array([parity(x) for x in sets], pa.binary()), "prefix": lists(prefix(x, frequent.value, similarity) for x in sets)}
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(node), *more.values()], names=["doc_id", "mark", "node", *more])

        return f

    prints = stored(given.mapInArrow(work(False), "doc_id long, mark long, node long, n long, code binary, parity binary, prefix array<long>"))
    codes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min("code").alias("code")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, set) of distinct nodes, stored."""
        asked = nodes.join(codes.select("node", "least"), "node")
        texts = given.join(asked.select("least").distinct().hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
        return stored(texts.mapInArrow(work(True), "doc_id long, mark long, node long, set array<long>").join(asked.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")))

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets reach the similarity."""
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = pairs.join(sets.withColumnRenamed("node", "a").withColumnRenamed("set", "x"), "a").join(sets.withColumnRenamed("node", "b").withColumnRenamed("set", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        right = stored(both.filter(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))
        discard(sets)
        return right

    found = stored(similar_links(codes.filter("n > 0"), similarity))
    nearest = found.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a", "b")
    near = similar(stored(nearest))
    groups = stored(components(near))
    one_each = prints.join(codes.select("node", "least"), "node").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "n", "prefix", "parity")
    far = prefix_links(one_each.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), similarity, sets_of)
    classes = components(near.unionByName(far))
    named = codes.select("node", "least").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    top = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = stored(prints.select("doc_id", "mark", "node").join(named.join(top, "component").select("node", "component", "component_id"), "node").drop("node"))
    discard(prints, codes, found, near, groups, far)
    return out


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates (``similar_documents``): of every class the row with the least id stays, all columns as they were.

    A row without an id takes one from its text's hash, above all real ids. Rows that share an id are judged by their own texts: each class
    keeps one of its rows with the least id, also where another class has the same least id. An empty table stays empty.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(text_col), F.lit(1 << 61)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), own.alias("own"), F.xxhash64(text_col).alias("mark"))
    found = similar_classes(rows.select("own", F.col("d").getField(text_col).alias("text")), words, similarity, "own", "text")
    least = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    kept = stored(least.groupBy("component").agg(F.min(F.struct("mark", "doc_id", "n")).alias("m")).select(F.col("m.doc_id").alias("own"), "m.mark", "m.n"))
    # The few numbers are hashed, the texts are not sorted: they are moved once at any size and never spilled.
    out = rows.join(kept.select("own", "mark").hint("shuffle_hash"), ["own", "mark"])
    if not kept.filter("n > 1").isEmpty():
        out = out.dropDuplicates(["own", "mark"])
    return out.select("d.*")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
