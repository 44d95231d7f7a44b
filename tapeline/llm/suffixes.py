"""Suffix order, common lengths and longest factors of many strings at once, in numpy.

Strings of bytes or of 32-bit units lie in one buffer, each with a separator after it that equals nothing else.
The suffix array comes from prefix doubling, the common lengths of neighbours from the ranks of each doubling, and
the nearest places with a smaller value in suffix order by jumps over those already known.
"""

from __future__ import annotations

import numpy as np

#: Bytes are packed so many to a first key, which has room for 257 digits.
_PACKED = 7


class Suffixes:
    """The suffix array of a buffer as far as `length` units tell suffixes apart.

    units holds the strings and a unit of any value after each of them; ends has for every place the place of its
    string's separator."""

    def __init__(self, units: np.ndarray, ends: np.ndarray, length: int) -> None:
        self.units, self.ends = units, ends
        n = len(units)
        self.left = ends - np.arange(n)
        if units.dtype == np.uint8:
            width, (key, self.order) = _PACKED, self._first()
        else:
            width, key = 1, np.where(self.left > 0, units.astype(np.int64) + 1, 0)
            self.order = np.argsort(key)
            key = key[self.order]
        new = np.ones(n, bool)
        alone = (self.left < width)[self.order]
        new[1:] = (key[1:] != key[:-1]) | alone[1:] | alone[:-1]
        self.new = [new]  # where in order a rank begins, by doubling: the order within a rank is all that changes later
        rank = np.empty(n, np.int32)  # for each suffix, where in order its rank begins
        rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        self.levels = [(width, rank)]
        while width < length:
            open_ = ~new
            open_[:-1] |= open_[1:]
            slots = np.flatnonzero(open_)  # suffixes that share their rank
            if not len(slots):
                break
            own = self.order.take(slots)
            key, order = _sorted(rank.take(own), rank.take(np.minimum(own + width, n - 1)), n)
            self.order[slots] = own = own.take(order)
            new, rank = new.copy(), rank.copy()
            new[slots[1:]] |= key[1:] != key[:-1]
            rank[own] = np.maximum.accumulate(np.where(new[slots], slots, 0))
            width *= 2
            self.new.append(new)
            self.levels.append((width, rank))

    def _first(self) -> tuple[np.ndarray, np.ndarray]:
        """The first _PACKED bytes of each suffix as a number, in order, and where the suffixes begin. Digits are the
        bytes that the buffer has, in their order, and 0 behind a string's end."""
        has = np.bincount(self.units, minlength=256) > 0
        base, n = int(has.sum()) + 1, len(self.units)
        digit = np.where(self.left > 0, np.cumsum(has)[self.units], 0)

        def behind(front: np.ndarray, back: np.ndarray, by: int, wide: int) -> np.ndarray:
            out = front * base**wide
            out[: max(n - by, 0)] += np.where(self.left[: max(n - by, 0)] > by, back[by:], 0)
            return out

        two = behind(digit, digit, 1, 1)
        key = behind(behind(two, two, 2, 2), behind(two, digit, 2, 1), 4, 3)
        bits = max(n - 1, 1).bit_length()
        if base**_PACKED << bits >= 1 << 63:
            order = np.argsort(key)
            return key[order], order
        key <<= bits
        key += np.arange(n)
        key.sort()
        return key >> bits, key & (1 << bits) - 1

    def shared(self, least: int = 0) -> np.ndarray:
        """What each suffix has in common with the one before it in order, 0 for the first; of suffixes that the
        last doubling leaves equal, its width. Lengths below `least` may be given too short."""
        a, b = self.order[:-1], self.order[1:]
        equal = sum((~new[1:]).view(np.uint8) for new in self.new)  # in so many levels, from the first on
        widths = np.array([0, *(width for width, _ in self.levels)])
        common = widths[equal]
        for k in range(len(self.levels) - 2, -1, -1):
            width, rank = self.levels[k]
            on = np.flatnonzero((equal > k + 1) & (equal < len(self.levels)) & (common + 2 * width > least))
            far = common.take(on)
            same = rank.take(a.take(on) + far) == rank.take(b.take(on) + far)
            common[on[same]] += width
        if self.levels[0][0] > 1:
            on = np.flatnonzero((equal < len(self.levels)) & (common + self.levels[0][0] > least))
            for _ in range(self.levels[0][0] - 1):
                x, y = a[on] + common[on], b[on] + common[on]
                on = on[(self.units[x] == self.units[y]) & (self.left[x] > 0) & (self.left[y] > 0)]
                common[on] += 1
        return np.concatenate([[0], common])[: len(self.order)]


def _sorted(first: np.ndarray, second: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two numbers below `below`, sorted, and where they stood. A key carries its own place where 64 bits have
    room for it, as values are sorted several times as fast as places."""
    bits = max(below - 1, len(first) - 1, 1).bit_length()
    if 3 * bits > 63:
        key = first.astype(np.int64) * below + second
        order = np.argsort(key)
        return key[order], order
    key = first.astype(np.int64) << bits
    key += second
    key <<= bits
    key += np.arange(len(key))
    key.sort()
    return key >> bits, key & (1 << bits) - 1


def with_copies(suffixes: Suffixes, shared: np.ndarray, lengths: np.ndarray, twice: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """order and shared, of all strings, as if some of them stood twice, the second right after the first: a suffix of
    the second follows that of the first in order and has all of it in common.

    lengths are the strings' with their separators, shared what Suffixes.shared() gives. Suffixes of less than `least`
    units are left out; those around them have less than that in common."""
    kept = np.flatnonzero((suffixes.left >= least)[suffixes.order])
    single, shared = suffixes.order[kept], shared[kept]
    string = np.repeat(np.arange(len(lengths)), lengths)
    shift = np.cumsum(np.where(twice, 2, 1) * lengths) - np.where(twice, 2, 1) * lengths - (np.cumsum(lengths) - lengths)
    own = string[single]
    again = twice[own]
    at = np.cumsum(1 + again) - 1 - again
    order, common = (np.empty(len(own) + int(again.sum()), np.int64) for _ in range(2))
    order[at], common[at] = single + shift[own], shared
    order[at[again] + 1] = order[at[again]] + lengths[own[again]]
    common[at[again] + 1] = suffixes.left[single[again]]
    return order, common


def _to_smaller(value: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each rank, what it shares with the nearest rank before it of smaller value."""
    n = len(value)
    at, met = np.arange(-1, n - 1), shared.copy()
    on = np.flatnonzero(np.concatenate([[False], (value[:-1] > value[1:]) & (shared[1:] >= least)]))
    while len(on):
        over = at[on]
        new, common = at[over], np.minimum(met[on], met[over])
        at[on], met[on] = new, common
        on = on[(new >= 0) & (common >= least) & (value[new] > value[on])]
    met[at < 0] = 0
    return met


def _both_ways(value: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    back = np.concatenate([[0], shared[1:][::-1]])[: len(shared)]
    found = np.maximum(_to_smaller(value, shared, least), _to_smaller(value[::-1], back, least)[::-1])
    return np.where(found < least, 0, found)


def factors(order: np.ndarray, shared: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of its longest match with an earlier and with a later place: that with the nearest
    smaller, and the nearest larger, place before it or after it in suffix order.

    order lists the places in suffix order and shared[k] is what suffixes k - 1 and k have in common.
    Matches of less than `least` count as 0."""
    earlier, later = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    earlier[order] = _both_ways(order, shared, least)
    later[order] = _both_ways(-order, shared, least)
    return earlier, later


def factors_elsewhere(order: np.ndarray, shared: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each place the length of its longest match with a place of another owner."""
    own = owner[order]
    far = int(shared.max(initial=0)) + 1

    def one_way(own: np.ndarray, shared: np.ndarray) -> np.ndarray:
        run = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
        return np.minimum.accumulate(shared - run * far) + run * far  # the least since the owner changed

    back = np.concatenate([[0], shared[1:][::-1]])[: len(shared)]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(one_way(own, shared), one_way(own[::-1], back)[::-1])
    return out
