"""Runs of periodic words in texts, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
max(`least`, 3 q) words long, that no neighbouring word extends without losing the period.

1. Ranks. Prefix doubling ranks all factors of 2^k words; equal factors have equal ranks, and a rank is the place in
   the suffix array where the factor's suffixes begin.
2. Dyadic blocks. At level k the blocks are the factors of m = 2^k words at multiples of m. A run of period q
   holds, with its copy q words further, a block of 8 words (q < 16) or of the largest power of two m <= q. The
   starts of a block's occurrences after it in the two neighbouring windows, (i, i + m] and (i + m, i + 2 m], are found by
   range successor over the block's range of the suffix array, on a wavelet matrix.
3. Progressions. Within a window the starts form an arithmetic progression. Up to two of them are candidate periods
   themselves. Three or more differ by the block's own period d; the block and its occurrences then lie in
   stretches of period d, and a longer period moves one such stretch onto another: the distances of
   their left ends and of their right ends are the candidates, so every block has a constant number of them.
4. Every candidate is extended in both directions by the ranks, which gives its exact run; of the periods of one stretch the
   smallest stays.

The texts of an Arrow batch are searched together, in arrays; only those that hold some 8 words twice (by hash, a
run has such) get past the first step. Texts meet nowhere else: no shuffle. Memory: some 200 bytes a word of a
batch's remaining texts; a batch is bounded, one text larger than the bound is a batch of its own.

Defined cases: null and empty texts have no runs and collapse to the empty text; repeated rows are rows of their own;
an empty table gives no rows; all input columns are passed through, those named like an added one are replaced by it.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from cladetally.llm.batches import beside_text
from cladetally.llm.columns import put_back, set_apart

LEAST_WORDS = 24
REPEATS = 3
FIRST_LEVEL = 3  # blocks of 8 words; a run of 24 words holds one and its copy
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class WaveletMatrix:
    """Counts and order statistics of ranges of an integer array, for arrays of questions at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros, self.before = [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            self.before.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(values) - one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def count_up_to(self, low, high, most):
        """How many values of [low, high) are at most `most`."""
        found = np.where(most >= (1 << self.bits) - 1, high - low, 0)
        below = np.clip(most + 1, 0, (1 << self.bits) - 1)
        open_ = most < (1 << self.bits) - 1
        for level, bit in enumerate(reversed(range(self.bits))):
            one = (below >> bit & 1).astype(bool)
            l0, h0 = self.before[level][low], self.before[level][high]
            found = found + np.where(one & open_, h0 - l0, 0)
            low = np.where(one, self.zeros[level] + low - l0, l0)
            high = np.where(one, self.zeros[level] + high - h0, h0)
        return found

    def nth(self, low, high, n):
        """The n-th smallest value of [low, high), from 0."""
        value = np.zeros(len(low), dtype=np.int64)
        for level, bit in enumerate(reversed(range(self.bits))):
            l0, h0 = self.before[level][low], self.before[level][high]
            small = h0 - l0
            one = n >= small
            n = np.where(one, n - small, n)
            low = np.where(one, self.zeros[level] + low - l0, l0)
            high = np.where(one, self.zeros[level] + high - h0, h0)
            value += one.astype(np.int64) << bit
        return value


class Factors:
    """Ranks of the factors of 2^k words of all levels, until every suffix has a rank of its own.

    `codes` holds the words of all texts; the code of a place between texts, and of both ends, occurs once."""

    def __init__(self, codes: np.ndarray):
        self.levels = []
        n, key, k = len(codes), codes.astype(np.int64), 0
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            starts = np.flatnonzero(first)
            rank = np.empty(n, dtype=np.int32)
            rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
            self.levels.append(rank)
            if len(starts) == n:
                self.suffixes = order
                return
            behind = np.full(n, -1, dtype=np.int64)
            behind[:n - (1 << k)] = rank[1 << k:] if 1 << k < n else 0
            key = rank.astype(np.int64) * (n + 1) + behind + 1
            k += 1

    def ahead(self, x, y):
        """How many words from x and y on are equal; x differs from y."""
        n, at = len(self.suffixes), np.zeros(len(x), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            rank, a, b = self.levels[k], x + at, y + at
            equal = (a < n) & (b < n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            at += np.where(equal, 1 << k, 0)
        return at

    def back(self, x, y):
        """How many words from x and y backwards are equal, x and y included."""
        at = np.zeros(len(x), dtype=np.int64)
        for k in reversed(range(len(self.levels))):
            rank, a, b = self.levels[k], x - at - (1 << k) + 1, y - at - (1 << k) + 1
            equal = (a >= 0) & (b >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            at += np.where(equal, 1 << k, 0)
        return at


def _candidates(factors: Factors, tree: WaveletMatrix):
    """Places and distances to try: two arrays for each level and window."""
    n = len(factors.suffixes)
    for k in range(FIRST_LEVEL, len(factors.levels)):
        m, rank = 1 << k, factors.levels[k]
        i = np.arange(0, n, m, dtype=np.int64)
        sizes = np.bincount(rank, minlength=n)[rank[i]]
        i, sizes = i[sizes > 1], sizes[sizes > 1]
        if not len(i):
            continue
        low = rank[i].astype(np.int64)
        high = low + sizes
        edges = [tree.count_up_to(low, high, i + reach) for reach in (0, m, 2 * m)]
        for since, until in zip(edges[:-1], edges[1:]):
            some = until > since
            at, lo, hi, c0, c1 = i[some], low[some], high[some], since[some], until[some]
            if not len(at):
                continue
            first = tree.nth(lo, hi, c0)
            yield at, first - at
            more = c1 - c0 > 1
            at, lo, hi, c0, c1, first = at[more], lo[more], hi[more], c0[more], c1[more], first[more]
            second = tree.nth(lo, hi, c0 + 1)
            yield at, second - at
            many = c1 - c0 > 2
            at, first, d = at[many], first[many], (second - first)[many]
            left, right = factors.back(at - 1, at - 1 + d), factors.ahead(at, at + d)
            left_there, right_there = factors.back(first - 1, first - 1 + d), factors.ahead(first, first + d)
            yield at, (first - left_there) - (at - left)
            yield at, (first + right_there) - (at + right)


def runs_of(codes: np.ndarray, least: int = LEAST_WORDS, repeats: int = REPEATS) -> np.ndarray:
    """Start, length and period of all runs, sorted; see `Factors` for the codes."""
    factors = Factors(codes)
    tree = WaveletMatrix(factors.suffixes)
    tried = [np.stack([at[step > 0], step[step > 0]]) for at, step in _candidates(factors, tree)]
    if not tried:
        return np.empty((0, 3), dtype=np.int64)
    at, step = np.unique(np.concatenate(tried, axis=1), axis=1)
    inside = at + step < len(codes)
    at, step = at[inside], step[inside]
    back = factors.back(at - 1, at - 1 + step)
    start, length = at - back, back + step + factors.ahead(at, at + step)
    found = np.stack([start, length, step], axis=1)[length >= np.maximum(least, repeats * step)]
    found = np.unique(found, axis=0)
    # One stretch has one smallest period; the others are its multiples.
    return found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])] if len(found) else found


def _with_ends(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts with an end mark of their own before, between and after them, and where the texts begin."""
    starts = np.cumsum(sizes) - sizes + np.arange(1, len(sizes) + 1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.empty(len(words) + len(sizes) + 1, dtype=np.int64)
    marks = np.append(starts - 1, len(codes) - 1)
    codes[marks] = -1 - np.arange(len(marks))
    # Words of different texts differ, so that ranks tell texts apart.
    inner = np.ones(len(codes), dtype=bool)
    inner[marks] = False
    codes[inner] = text * (int(words.max(initial=0)) + 1) + words
    return codes, starts


def _repeats_a_block(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts hold some 8 words twice, by hash."""
    h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    for k in range(FIRST_LEVEL):
        h = (h[:-(1 << k)] * np.uint64(0xBF58476D1CE4E5B9)) ^ h[1 << k:]
        h ^= h >> np.uint64(29)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[:len(h)] == text[len(text) - len(h):]
    owner = text[:len(h)][whole]
    h = h[whole] * np.uint64(0x94D049BB133111EB) + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(h)
    twice = np.flatnonzero(h[order][1:] == h[order][:-1])
    marked = np.zeros(len(sizes), dtype=bool)
    marked[owner[order[twice]]] = True
    return marked


def search(texts: list[list[bytes]], least: int = LEAST_WORDS, repeats: int = REPEATS) -> list[np.ndarray]:
    """Runs of each text, given as its words: rows of start, length, period in order."""
    none = np.empty((0, 3), dtype=np.int64)
    out = [none] * len(texts)
    number = np.array([i for i, words in enumerate(texts) if len(words) >= least], dtype=np.int64)
    for keep in (_repeats_a_block, None):
        if not len(number):
            return out
        sizes = np.array([len(texts[i]) for i in number], dtype=np.int64)
        flat = np.empty(int(sizes.sum()), dtype=object)
        flat[:] = [w for i in number for w in texts[i]]
        words = pd.factorize(flat)[0].astype(np.int64)
        if keep is not None:
            number = number[keep(words, sizes)]
    codes, starts = _with_ends(words, sizes)
    found = runs_of(codes, least, repeats)
    owner = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, 0] -= starts[owner]
    edges = np.searchsorted(owner, np.arange(len(number) + 1))
    for j, i in enumerate(number):
        out[i] = found[edges[j]:edges[j + 1]]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, stays in zip(words, kept.tolist()) if stays])


def found_in(texts: list[str | None], least: int = LEAST_WORDS, repeats: int = REPEATS) -> list[pa.Array]:
    """The columns `runs` and `collapsed` of a batch of texts."""
    # ASCII white space separates words.
    words = [(t or "").encode().split() for t in texts]
    runs = search(words, least, repeats)
    flat = np.concatenate([*runs, np.empty((0, 3), dtype=np.int64)])
    fields = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs], dtype=np.int64)]).astype(np.int32)
    kept = pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
    return [pa.ListArray.from_arrays(pa.array(offsets), fields), kept]


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, repeats: int = REPEATS) -> DataFrame:
    """`docs` with `runs` (start and length in words from 0, period) in order of start and period, and the `collapsed` text."""
    if least < 24 or repeats < 3:
        raise ValueError("blocks cover runs of at least 24 words and three periods")
    plain, names = set_apart(docs, {"text"})
    found = beside_text(plain, lambda texts: found_in(texts, least, repeats), f"runs {RUNS}, collapsed string")
    return put_back(found, names, ("runs", "collapsed"))
