"""A compressed full-text index over integer symbols, for one shard of a corpus.

The Burrows-Wheeler transform of the text is held in a wavelet tree (in matrix form: one
packed bit vector a level with counts every 64 bits).  Backward search runs for all patterns
at once.  Symbol 0 separates the pieces of the text; patterns never contain it.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        b = np.packbits(bits, bitorder="little")
        packed[: len(b)] = b
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        at = symbols
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = ((at >> bit) & 1).astype(bool)
            v = BitVector(b)
            self.levels.append((bit, v, len(at) - v.ones))
            at = np.concatenate([at[~b], at[b]])
        # where each symbol's own stretch begins below the last level
        c = np.arange(sigma)
        begin = np.zeros(sigma, np.int64)
        for bit, v, zeros in self.levels:
            a = v.rank(begin)
            begin = np.where((c >> bit) & 1 > 0, zeros + a, begin - a)
        self.begin = begin

    def rank_pair(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol ``c`` occurs before ``lo`` and before ``hi``."""
        start = self.begin[c]
        for bit, v, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = v.rank(lo), v.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return lo - start, hi - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i`` and how often each occurs before its place."""
        c = np.zeros_like(i)
        for bit, v, zeros in self.levels:
            one = (v.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0
            a = v.rank(i)
            i = np.where(one, zeros + a, i - a)
            c |= one.astype(c.dtype) << bit
        return c, i - self.begin[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; each 0 is a symbol of its own, so no comparison passes a separator."""
    n = len(text)
    seps = text == 0
    k = int(seps.sum())
    rank = np.where(seps, np.cumsum(seps) - 1, text.astype(np.int64) + k - 1)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        r = rank[order]
        fresh = np.empty(n, bool)
        fresh[0] = True
        if step == 1:
            fresh[1:] = r[1:] != r[:-1]
        else:
            s = second[order]
            fresh[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        ids = np.cumsum(fresh) - 1
        rank = np.empty(n, np.int64)
        rank[order] = ids
        done = ids[-1] == n - 1
        if done:
            return order
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        # only rows that still tie need sorting again
        single = np.ones(n, bool)
        single[1:] &= fresh[1:]
        single[:-1] &= fresh[1:]
        tied = np.flatnonzero(~single)
        rows = order[tied]
        order = order.copy()
        order[tied] = rows[np.argsort(rank[rows] * (n + 1) + second[rows] + 1, kind="stable")]
        step *= 2


class FMIndex:
    """``text``: symbols with 0 as separator after every piece (the last symbol is 0).

    ``sample``: distance of located suffixes.
    """

    def __init__(self, text: np.ndarray, sample: int = 16):
        n = len(text)
        sa = suffix_array(text)
        self.n = n
        self.sigma = int(text.max()) + 1
        bwt = text[sa - 1]
        self.tree = WaveletTree(bwt, self.sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        # the starts of pieces are always sampled, so a walk back never meets a separator
        piece = np.zeros(n, bool)
        piece[0] = True
        piece[1:] = text[:-1] == 0
        keep = piece | (np.arange(n) % sample == 0)
        self.marked = BitVector(keep[sa])
        self.samples = sa[keep[sa]]

    def repeats(self, text: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams pieces of ``text`` that end with the words at ``last`` backwards through the tree.

        Returns how many words, up to ``length``, each matches at more than one place, and the range
        of the suffixes that begin with those.  The pieces are indexed text, so a range of one row is
        the piece's own place and its search ends there.
        """
        lo, hi = np.zeros(len(last), np.int64), np.full(len(last), self.n, np.int64)
        matched = np.zeros(len(last), np.int64)
        live = np.arange(len(last))
        for j in range(length):
            c = text[last[live] - j]
            a, b = self.tree.rank_pair(c, lo[live], hi[live])
            more = b - a > 1
            live, c, a, b = live[more], c[more], a[more], b[more]
            lo[live], hi[live] = self.first[c] + a, self.first[c] + b
            matched[live] = j + 1
        return matched, lo, hi

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the rows of ``patterns`` (symbols from 1 to sigma - 1; others occur nowhere)."""
        q, length = patterns.shape
        lo, hi = np.zeros(q, np.int64), np.full(q, self.n, np.int64)
        known = ((patterns > 0) & (patterns < self.sigma)).all(1)
        lo[~known] = hi[~known] = 0
        live = np.flatnonzero(known)
        for j in range(length - 1, -1, -1):
            if not len(live):
                break
            c = patterns[live, j]
            a, b = self.tree.rank_pair(c, lo[live], hi[live])
            lo[live], hi[live] = self.first[c] + a, self.first[c] + b
            live = live[a < b]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the nearest sampled one."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), np.int64)
        walk = np.arange(len(rows))
        steps = 0
        while len(walk):
            at = rows[walk]
            hit = (self.marked.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            out[walk[hit]] = self.samples[self.marked.rank(at[hit])] + steps
            walk, at = walk[~hit], at[~hit]
            c, before = self.tree.access(at)
            rows[walk] = self.first[c] + before
            steps += 1
        return out
