"""Two-dimensional range reporting over points that are a permutation, by a level-wise wavelet tree."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Point j has the place j on one axis and values[j] on the other; values are a permutation of 0 to n - 1.

    Level k holds the points stably sorted by the top k bits of their values, and for each place the count of ones
    before it in the next bit. As values are a permutation, the node of prefix p starts at place p << (bits - k)."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.ones, row = [], values.astype(np.int64)
        for k in range(self.bits):
            bit = (row >> (self.bits - 1 - k)) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            row = row[np.argsort(row >> (self.bits - 1 - k), kind="stable")]

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the points with a place in [left, right) and a value in [low, high): the numbers of the
        queries and the values found, the queries' walks down the tree being taken level by level at once."""
        query = np.flatnonzero((left < right) & (low < high))
        l, r, node = left[query], right[query], np.zeros(len(query), np.int64)
        for k, ones in enumerate(self.ones):
            width = self.bits - k - 1
            start = np.minimum(node << (width + 1), self.n)
            middle = np.minimum((2 * node + 1) << width, self.n)
            to_l, to_r = ones[l] - ones[start], ones[r] - ones[start]
            parts = []
            for child, a, b in ((0, l - to_l, r - to_r), (1, middle + to_l, middle + to_r)):
                least = (2 * node + child) << width
                keep = (a < b) & (least < high[query]) & (least + (1 << width) > low[query])
                parts.append((query[keep], a[keep], b[keep], 2 * node[keep] + child))
            query, l, r, node = (np.concatenate(x) for x in zip(*parts, strict=True))
        return query, node
