"""Bin completion: branch and bound over fillings of the bin that holds the largest piece.

The search knows pieces by their length alone, so it works on a table of at
most ``size`` counts, however many pieces there are, and applies a filling as
often as its lengths last. Its state and its result are bounded by ``size``.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np

#: Steps of all enumerations of a search together, some seconds, and of one of
#: them; to apply a filling and bound what is left costs as much as some steps. The problem is NP-hard; beyond them the best packing so far
#: stays. All pieces are packed in any case.
STEPS = 400_000
STEPS_EACH = 3_000
APPLIED = 25
#: Enumerations that are held; each has a few lists of up to ``size`` numbers.
LIVE = 64

#: Lengths in descending order, and how many bins are filled so.
Filling = tuple[tuple[int, ...], int]


def least_bins(counts: np.ndarray) -> int:
    """A lower bound on bins, from the waste that pieces over half a bin force.

    For each ``a`` pieces over ``size - a`` are alone, others over half a bin
    apart, and pieces of ``a`` to half a bin fill first what the latter leave.
    """
    size = len(counts) - 1
    n = np.concatenate([[0], np.cumsum(counts)])  # n[i]: pieces shorter than i
    total = np.concatenate([[0], np.cumsum(counts * np.arange(size + 1))])
    half = size // 2
    a = np.arange(half + 1)
    alone = n[-1] - n[size - a + 1]
    apart = n[size - a + 1] - n[half + 1]
    room = apart * size - (total[size - a + 1] - total[half + 1])
    rest = total[half + 1] - total[a] - room
    return int((alone + apart + np.maximum(0, -(-rest // size))).max())


def best_fit(counts: np.ndarray) -> list[Filling]:
    """Best fit of pieces in descending length; bins that are filled alike are one entry."""
    size = len(counts) - 1
    groups: dict[int, list[Filling]] = {}
    rooms: list[int] = []

    def put(room: int, held: tuple[int, ...], times: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((held, times))

    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        while left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                held, times = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, held, times = size, (), left
            # The bin that took a piece has the least room that fits the next one as long.
            each = min(room // n, left)
            took = min(times, left // each)
            if held and took < times:
                put(room, held, times - took)
            put(room - each * n, held + (n,) * each, took)
            left -= took * each
    return [filling for room in rooms for filling in groups[room]]


def dominated(filling: list[int], waste: int, unused: int) -> bool:
    """Whether one unused length could stand for some of ``filling`` and waste less, or be one piece for two.

    ``filling`` leaves out the largest piece; ``unused`` has a bit for each
    length of which a piece remains. No bin needs a dominated filling: the
    pieces that the longer one replaces fit where it was.
    """
    sums, pairs = 1, 0  # bit s: pieces that sum to s; those of two or more
    for n in filling:
        pairs |= (pairs | (sums & ~1)) << n
        sums |= sums << n
    if unused & pairs:
        return True
    if not waste:
        return False
    larger, by = sums << 1, 1
    while by < waste:
        step = min(by, waste - by)
        larger |= larger << step
        by += step
    return bool(unused & larger)


class _Room:
    """One bin's enumeration: what may still be put in, what is in, and the steps left to it."""

    def __init__(self, counts: np.ndarray, largest: int, waste: int, steps: int):
        have = counts.copy()
        have[largest] -= 1
        self.lengths = np.flatnonzero(have).tolist()
        # All pieces up to a length together: a gap beyond that cannot be closed.
        self.sums = np.cumsum(have * np.arange(len(have))).tolist()
        self.available = int.from_bytes(np.packbits(have > 0, bitorder="little").tobytes(), "little")
        self.have = have.tolist()
        self.waste, self.steps = waste, steps
        self.held: list[int] = []


def _leaf(r: _Room, room: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    used_up = sum(1 << n for n, c in Counter(r.held).items() if r.have[n] == c)
    if room <= r.waste and not dominated(r.held, room, r.available & ~used_up):
        yield room, tuple(r.held)


def _walk(r: _Room, at: int, room: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Fillings of ``room`` with lengths up to the one at ``at``, with what they leave."""
    r.steps -= 1
    at = min(at, bisect_right(r.lengths, room) - 1)
    if at >= 0 and r.lengths[at] == room:
        # One piece that fills the room dominates all else behind these pieces.
        r.held.append(room)
        yield from _leaf(r, 0)
        r.held.pop()
        return
    while at >= 0 and r.steps > 0 and r.sums[r.lengths[at]] >= room - r.waste:
        n = r.lengths[at]
        for m in range(min(r.have[n], room // n), 0, -1):
            r.held.extend([n] * m)
            yield from _walk(r, at - 1, room - m * n)
            del r.held[-m:]
            if r.steps <= 0:
                return
        at -= 1
    yield from _leaf(r, room)


def fillings(counts: np.ndarray, largest: int, waste: int, budget: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of the bin of ``largest`` that leave at most ``waste``.

    Longer pieces are tried first; what fills a bin comes as it is found, the
    others follow by what they leave. ``budget`` holds the steps that all
    enumerations have left.
    """
    budget = budget if budget is not None else [STEPS]
    r = _Room(counts, largest, waste, given := min(STEPS_EACH, budget[0]))
    rest = []
    for room, found in _walk(r, len(r.lengths) - 1, len(counts) - 1 - largest):
        budget[0] -= given - r.steps
        given = r.steps
        if room:
            rest.append((room, found))
        else:
            yield (largest, *found)
    budget[0] -= given - r.steps
    yield from ((largest, *found) for _, found in sorted(rest, key=lambda x: x[0]))


def complete(counts: np.ndarray, steps: int = STEPS) -> tuple[list[Filling], int]:
    """Fillings that use up ``counts`` (pieces by length, up to the bin's size), and the lower bound on bins.

    Best fit is the first incumbent. A branch ends where the bins that it has
    and the least that the rest needs are no fewer than the incumbent's; only
    best fit's number may be met again, by fillings that are undominated.
    """
    counts = np.array(counts, dtype=np.int64)
    if counts[0]:
        raise ValueError("a piece of length zero needs no bin")
    size = len(counts) - 1
    best = best_fit(counts)
    fewest = sum(times for _, times in best) + 1
    low = least_bins(counts)
    total = int((counts * np.arange(size + 1)).sum())
    chosen: list[Filling] = []
    wasted = [0]  # by the fillings chosen so far
    used, budget = 0, [steps]

    def branch():
        largest = int(np.flatnonzero(counts)[-1])
        # What may be left in all with one bin fewer than the incumbent has.
        waste = (fewest - 1) * size - total - wasted[-1]
        for filling in fillings(counts, largest, min(size, waste), budget):
            most = min(int(counts[n]) // m for n, m in Counter(filling).items())
            yield filling, most
            if most > 1:
                yield filling, 1

    def apply(filling: tuple[int, ...], times: int) -> None:
        for n, m in Counter(filling).items():
            counts[n] -= m * times

    # A branch is an enumeration and how many of its steps were taken; one far
    # down is made anew if the search comes back to it.
    open_: list[list] = [[branch(), 0]] if total else []
    while open_ and fewest > low and budget[0] > 0:
        if len(open_) > LIVE:
            open_[-LIVE - 1][0] = None
        top = open_[-1]
        if top[0] is None:
            top[0] = islice(branch(), top[1], None)
        step = next(top[0], None)
        top[1] += 1
        if step is None:
            open_.pop()
            if chosen:
                filling, times = chosen.pop()
                wasted.pop()
                used -= times
                apply(filling, -times)
            continue
        budget[0] -= APPLIED
        filling, times = step
        spare = wasted[-1] + (size - sum(filling)) * times
        if spare > (fewest - 1) * size - total:
            continue
        apply(filling, times)
        if used + times + least_bins(counts) >= fewest:
            apply(filling, -times)
            continue
        chosen.append(step)
        wasted.append(spare)
        used += times
        if counts.any():
            open_.append([branch(), 0])
        else:
            best, fewest = list(chosen), used
            open_.append([iter(()), 0])
    return best, low
