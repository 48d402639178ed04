"""Runs of a sequence by Lyndon roots: two right-to-left stacks and a rolling hash.

A run is a maximal stretch with a smallest period. In one of the two orders of
the alphabet the longest Lyndon word at some place of it is as long as that
period, so the longest Lyndon words in both orders name all runs; each is then
extended by longest common extensions, which a rolling hash finds by binary
search, and held to the words themselves.
"""

from __future__ import annotations

import numpy as np

#: A run has at least so many words and so many periods.
LEAST = 6
TIMES = 4
#: Words that must recur for a stretch to be looked at.
GRAM = 4
#: Words compared one by one before the hash is asked.
DIRECT = 8
_P = (1 << 61) - 1
_BASE = 1_114_111_985_463_217_923

Run = tuple[int, int, int]  # start, end, period


class Extensions:
    """Longest common extensions of two places of a sequence of numbers, by hashes modulo 2^61 - 1."""

    def __init__(self, w: list[int]):
        self.w, self.n = w, len(w)
        h, pw = [0] * (self.n + 1), [1] * (self.n + 1)
        a, b = 0, 1
        for k, x in enumerate(w, 1):
            h[k] = a = (a * _BASE + x + 1) % _P
            pw[k] = b = b * _BASE % _P
        self.h, self.pw = h, pw
        self.nearest: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, m: int) -> bool:
        """Whether ``m`` words from ``i`` and from ``j`` have one hash."""
        h = self.h
        return ((h[i] - h[j]) * self.pw[m] - h[i + m] + h[j + m]) % _P == 0

    def _search(self, top: int, same) -> int:
        """The greatest ``m`` up to ``top`` for which ``same(m)``, by doubling and halving."""
        low, step = 0, DIRECT
        while low + step <= top and same(low + step):
            low, step = low + step, 2 * step
        high = min(low + step, top + 1)
        while high - low > 1:
            mid = (low + high) // 2
            if same(mid):
                low = mid
            else:
                high = mid
        return low

    def forward(self, i: int, j: int) -> int:
        """Words that agree from ``i`` and ``j > i`` on."""
        w, top, k, p = self.w, self.n - j, 0, j - i
        while k < DIRECT and k < top:
            if w[i + k] != w[j + k]:
                return k
            k += 1
        if k == top:
            return k
        # What was found at this distance a little to the right goes on to there.
        at, beyond = self.nearest.get(p, (0, 0))
        if i < at <= i + DIRECT:
            k = at - i + beyond
        else:
            k = self._search(top, lambda m: self.same(i, j, m))
        self.nearest[p] = i, k
        return k

    def backward(self, i: int, j: int) -> int:
        """Words that agree before ``i`` and ``j > i``."""
        w, k = self.w, 0
        while k < DIRECT and k < i:
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
            k += 1
        return k if k == i else self._search(i, lambda m: self.same(i - m, j - m, m))


def lyndon_ends(w: list[int], forward) -> list[int]:
    """Where the longest Lyndon word from each place ends: the next place with a smaller suffix.

    ``w`` is in the order wanted; a suffix that ends is smaller than what goes
    on. The places between a place and its end form the stack, linked by their ends.
    """
    n = len(w)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        a, j = w[i], i + 1
        while j < n:
            b = w[j]
            if a > b:
                break
            if a == b:
                k = forward(i, j)
                if j + k == n or w[i + k] > w[j + k]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def _extended(w: list[int], i: int, j: int) -> tuple[int, int]:
    """The stretch of period ``j - i`` around ``i``, word by word."""
    p, s, e = j - i, i, j
    while e < len(w) and w[e] == w[e - p]:
        e += 1
    while s and w[s - 1] == w[s - 1 + p]:
        s -= 1
    return s, e


def runs_of(w: list[int], least: int = LEAST, times: int = TIMES) -> set[Run]:
    """All runs of a whole sequence with at least ``least`` words and ``times`` (2 or more) periods."""
    if len(w) < least:
        return set()
    ext = Extensions(w)
    found: dict[tuple[int, int], int] = {}
    for order in (w, [-x for x in w]):
        ends = lyndon_ends(order, ext.forward)
        last: dict[int, tuple[int, int]] = {}
        for i in range(len(w) - 1, -1, -1):
            j = ends[i]
            p = j - i
            s, e = last.get(p, (j, i))
            if s <= i and j <= e:
                continue
            if not (j < len(w) and w[i] == w[j]) and not (i and w[i - 1] == w[j - 1]):
                continue
            s, e = i - ext.backward(i, j), j + ext.forward(i, j)
            # The words decide, not their hashes.
            if w[s : e - p] != w[s + p : e]:
                s, e = _extended(w, i, j)
            last[p] = s, e
            if e - s >= max(least, times * p):
                # A Lyndon word has no smaller period, so the least is the run's own.
                found[s, e] = min(p, found.get((s, e), p))
    return {(s, e, p) for (s, e), p in found.items()}


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Parts of a sequence outside which no run can lie, each with a word more on either side.

    In a run of period q, every four words but the first q recur q words after
    they last came, so such places lie side by side, at least (TIMES - 1) q -
    GRAM + 1 of them, and each has its like within q. Places that are too few
    for their distance are struck out until none is; a hash that two fours
    share strikes out nothing more.
    """
    n = len(ids) - GRAM + 1
    if n + GRAM - 1 < LEAST:
        return []
    x = ids.astype(np.uint64)
    gram = x[:n].copy()
    for k in range(1, GRAM):
        gram = gram * np.uint64(_BASE) + x[k : n + k]
    order = np.argsort(gram, kind="stable")
    before, after = order[:-1], order[1:]
    again = gram[before] == gram[after]
    far = np.full(n, n, np.int64)
    far[after[again]] = (after - before)[again]
    live = far < n
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return []
        longest = (ends - starts + GRAM - 1) // (TIMES - 1)
        kept = np.zeros(n, bool)
        kept[live] = far[live] <= np.repeat(longest, ends - starts)
        if (kept == live).all():
            break
        live = kept
    enough = ends - starts >= LEAST - GRAM
    out: list[tuple[int, int]] = []
    for s, e, q in zip((starts[enough]).tolist(), ends[enough].tolist(), longest[enough].tolist(), strict=True):
        s, e = max(0, s - q - 1), min(len(ids), e + GRAM)
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def runs(words: list) -> list[Run]:
    """Runs (start, end, period) of a sequence of hashable words with LEAST words and TIMES periods, by start, then period."""
    number: dict = {}
    ids = [number.setdefault(x, len(number)) for x in words]
    out = []
    for s, e in stretches(np.array(ids, np.int64)):
        for a, b, p in runs_of(ids[s:e]):
            a, b = a + s, b + s
            # A stretch that goes on past its part is met whole in another one.
            if not (a == s > 0 and ids[a - 1] == ids[a - 1 + p]) and not (b == e < len(ids) and ids[b] == ids[b - p]):
                out.append((a, b, p))
    return sorted(out, key=lambda r: (r[0], r[2]))
