"""Character models with back-off, kept in sorted hash arrays, that score words in bulk."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Symbol codes before those of characters: the start and the end of a word.
START, STOP, FIRST = 1, 2, 3
#: One odd 64-bit factor per place, without small linear relations, so that sums of codes times factors hardly ever meet.
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def spell(word: str) -> str:
    """A word as a string of symbols: its characters between a start and a stop mark."""
    return "\x01" + word + "\x02"


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol codes of the spelled words on end, each symbol's place in its word, and where words begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    codes = np.zeros(len(place), np.uint64)
    inner = np.ones(len(place), bool)
    inner[first] = False
    inner[first + sizes - 1] = False
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + FIRST
    codes[first] = START
    codes[first + sizes - 1] = STOP
    return codes, place, first


def gram_hash(gram: str) -> int:
    """Hash of a symbol string whose marks are written as in ``spell``; position counts from its end."""
    total = 0
    for j, ch in enumerate(reversed(gram)):
        total += {"\x01": START, "\x02": STOP}.get(ch, ord(ch) + FIRST) * int(_FACTORS[j])
    return total & 0xFFFFFFFFFFFFFFFF


def context_hash(context: str) -> int:
    """Hash of the symbols before a next one."""
    total = 0
    for j, ch in enumerate(reversed(context), 1):
        total += {"\x01": START, "\x02": STOP}.get(ch, ord(ch) + FIRST) * int(_FACTORS[j])
    return total & 0xFFFFFFFFFFFFFFFF


def _sorted(keys: Iterable[int], values: list) -> tuple[np.ndarray, np.ndarray]:
    k = np.fromiter(keys, np.uint64)
    order = np.argsort(k)
    return k[order], np.array(values, dtype=np.float32)[order]


class Backoff:
    """grams[k]: symbol strings of k + 1 symbols with a log probability of the last one in each of the models; contexts[k]: strings of k
    symbols with the log weight for going on to a shorter context. What no order knows gets ``floor``."""

    def __init__(self, grams: list[dict[str, list[float]]], contexts: list[dict[str, list[float]]], models: int, floor: float):
        shape = lambda d, h: _sorted((h(g) for g in d), list(d.values()) or np.zeros((0, models)))
        self.grams = [shape(d, gram_hash) for d in grams]
        self.contexts = [shape(d, context_hash) for d in contexts]
        self.models, self.floor = models, floor

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def score(self, words: list[str], part: int = 100_000) -> np.ndarray:
        """Log probability (words x models) of the spelled words, from their first character to the stop mark."""
        out, begin = [], 0
        while begin < len(words):
            end, n = begin, 0
            while end < len(words) and (end == begin or n + len(words[end]) < part):
                n += len(words[end])
                end += 1
            out.append(self._part(words[begin:end]))
            begin = end
        return np.concatenate(out) if out else np.zeros((0, self.models))

    def _part(self, words: list[str]) -> np.ndarray:
        codes, place, first = _codes(words)
        with np.errstate(over="ignore"):
            context = [np.zeros(len(codes), np.uint64)]
            for k in range(1, len(self.grams)):
                shifted = np.zeros(len(codes), np.uint64)
                shifted[k:] = codes[:-k] * _FACTORS[k]
                context.append(context[-1] + shifted)
            last = codes * _FACTORS[0]
        total = np.zeros((len(codes), self.models))
        open_ = np.flatnonzero(place > 0)
        for k in range(len(self.grams) - 1, -1, -1):
            fits = place[open_] >= k
            here = open_[fits]
            ctx = context[k][here]
            with np.errstate(over="ignore"):
                at, hit = self._find(self.grams[k][0], ctx + last[here])
            total[here[hit]] += self.grams[k][1][at[hit]]
            rest = here[~hit]
            at, known = self._find(self.contexts[k][0], ctx[~hit])
            total[rest[known]] += self.contexts[k][1][at[known]]
            open_ = np.concatenate([open_[~fits], rest])
        total[open_] += self.floor
        return np.add.reduceat(total, first, axis=0)


class WordScores:
    """Scores of words by a ``Backoff``, remembered by a worker up to ``most`` words; then it starts anew. Only speed depends on it."""

    def __init__(self, model: Backoff, most: int = 600_000, most_bytes: int = 64 << 20):
        self.model, self.most, self.most_bytes = model, most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.at: dict = {}
        self.bytes = 0
        self.table = np.zeros((1 << 14, self.model.models))

    def rows(self, words: list) -> np.ndarray:
        """Row numbers in ``table`` of the words, valid until the next call."""
        new = list(set(words).difference(self.at))
        if new:
            if len(self.at) + len(new) > self.most or self.bytes > self.most_bytes:
                self._clear()
                new = list(set(words))
            n = len(self.at)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = self.model.score(new)
            self.at.update(zip(new, range(n, n + len(new))))
            self.bytes += sum(map(len, new))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
