"""Order statistics of all pairwise slopes of a series, without the array of pairs.

The slope of two points is below s where the order of y - s x turns against the
order of x, so counting the slopes below s is counting inversions: O(n log n).
A rank is found by narrowing an interval of slopes: inversions between the orders
at its two ends are the slopes inside; a random sample of those gives the next
interval, and once few are left they are listed and the rank is read off. Memory
is O(n) whatever the number of pairs.
"""

import math
import sys

import numpy as np
from pyspark import cloudpickle

# The fit travels to executors as code, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = 65_536  # pairs that may be listed at once, or LISTED_PER_POINT per point if that is more
LISTED_PER_POINT = 16
SAMPLE = 4096
SEED = 20_240_101


class _Inversions:
    """Pairs (earlier, later) of an order whose ranks fall, by the highest bit in which the ranks differ.

    Ranks are split bit by bit. Within the ranks that agree in all higher bits, a
    pair is an inversion where a 1 stands before a 0; so each level holds, for
    every 0, how many 1s stand before it.
    """

    def __init__(self, ranks):
        n = len(ranks)
        self.levels, self.total = [], 0
        places = np.arange(n)
        for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
            # Stable by the higher bits: places of equal higher bits stay in order.
            high = ranks[places] >> (bit + 1)
            one = (ranks[places] >> bit) & 1
            ones_before = np.cumsum(one) - one
            first = np.concatenate([[True], high[1:] != high[:-1]]) if n else np.zeros(0, bool)
            at_start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            start = ones_before[at_start]
            zeros = np.flatnonzero(one == 0)
            counts = (ones_before - start)[zeros]
            self.levels.append((places[one == 1], places[zeros], start[zeros], np.cumsum(counts)))
            self.total += int(counts.sum())
            places = places[np.argsort((high << 1) | one, kind="stable")]

    def pairs(self, numbers):
        """The inversions of the given numbers, 0 .. total - 1, as two arrays of places."""
        numbers = np.sort(numbers)
        earlier, later, done = [], [], 0
        for ones, zeros, start, upto in self.levels:
            size = int(upto[-1]) if len(upto) else 0
            mine = numbers[np.searchsorted(numbers, done) : np.searchsorted(numbers, done + size)] - done
            zero = np.searchsorted(upto, mine, side="right")
            nth = mine - np.where(zero > 0, upto[zero - 1], 0)
            earlier.append(ones[start[zero] + nth])
            later.append(zeros[zero])
            done += size
        return np.concatenate(earlier), np.concatenate(later)


class PairwiseSlopes:
    """The slopes (y_j - y_i) / (x_j - x_i) of all pairs with x_i < x_j, by rank."""

    def __init__(self, x, y, listed=LISTED):
        order = np.lexsort((y, x))
        # Around the middle, so that y - s x keeps its digits.
        self.x, self.y = x[order] - (x.max() + x.min()) / 2, y[order]
        self.raw_x, n = x[order], len(x)
        _, same = np.unique(self.raw_x, return_counts=True)
        self.count = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
        steps = np.diff(self.raw_x)
        self.least_step = steps[steps > 0].min() if self.count else math.inf
        self.listed = max(listed, LISTED_PER_POINT * n)
        self.random = np.random.default_rng(SEED)

    def _order(self, slope):
        """Points by y - slope * x; those on one line keep the order of x, as slopes equal to it are not below it."""
        # Points of one x never turn: they are in the order of y at either end.
        if math.isinf(slope):
            return np.lexsort((self.y, self.raw_x if slope < 0 else -self.raw_x))
        return np.lexsort((self.y, self.raw_x, self.y.astype(np.longdouble) - np.longdouble(slope) * self.x))

    def _between(self, low, high):
        """The slopes from low up to, not including, high."""
        first, last = self._order(low), self._order(high)
        ranks = np.empty(len(last), dtype=np.int64)
        ranks[last] = np.arange(len(last))
        return _Inversions(ranks[first]), first

    def _below(self, slope):
        return self._between(-math.inf, slope)[0].total

    def _slopes(self, inversions, first, numbers):
        a, b = inversions.pairs(numbers)
        a, b = first[a], first[b]
        i, j = np.where(self.raw_x[a] < self.raw_x[b], a, b), np.where(self.raw_x[a] < self.raw_x[b], b, a)
        return np.sort((self.y[j] - self.y[i]) / (self.raw_x[j] - self.raw_x[i]))

    def _blur(self, slope):
        """How far rounding may move a point's turn from the slope."""
        size = np.abs(self.y).max() + abs(slope) * np.abs(self.x).max()
        exact = float(np.finfo(np.longdouble).eps) * size / self.least_step
        return 8 * (exact + np.finfo(float).eps * abs(slope)) + np.finfo(float).tiny

    def at_ranks(self, ranks):
        """The slopes of some ranks. A short series, of up to LISTED pairs, simply lists them."""
        if len(self.raw_x) * (len(self.raw_x) - 1) // 2 > LISTED:
            found = {rank: self.at_rank(rank) for rank in set(ranks)}
            return [found[rank] for rank in ranks]
        i, j = np.triu_indices(len(self.raw_x), 1)
        apart = self.raw_x[i] < self.raw_x[j]
        i, j = i[apart], j[apart]
        slopes = (self.y[j] - self.y[i]) / (self.raw_x[j] - self.raw_x[i])
        return np.partition(slopes, sorted(set(ranks)))[list(ranks)].tolist()

    def at_rank(self, rank):
        """The slope of a rank from 0 in ascending order."""
        low, high, below = -math.inf, math.inf, 0
        while True:
            inversions, first = self._between(low, high)
            if inversions.total <= self.listed:
                return self._slopes(inversions, first, np.arange(inversions.total))[rank - below]
            drawn = self.random.integers(0, inversions.total, SAMPLE)
            sample = self._slopes(inversions, first, drawn)
            # Three standard deviations of a sample quantile on both sides.
            share = (rank - below + 0.5) / inversions.total
            reach = 3 * math.sqrt(share * (1 - share) / SAMPLE) + 1 / SAMPLE
            a, b = math.floor((share - reach) * SAMPLE), math.ceil((share + reach) * SAMPLE)
            bottom, top = sample[max(a, 0)], sample[min(b, SAMPLE - 1)]
            left, right = bottom - self._blur(bottom), top + self._blur(top)
            if top - bottom <= self._blur(top):
                # Slopes so often equal that listing them is no use; the rank is among them or beside them.
                under, upto = self._below(left), self._below(right)
                if under <= rank < upto:
                    return bottom
                low, high, below = (low, left, below) if rank < under else (right, high, upto)
                continue
            left = max(left, low) if a >= 0 else low
            right = min(right, high) if b < SAMPLE else high
            whole = below + inversions.total
            under = self._below(left) if left > low else below
            upto = self._below(right) if right < high else whole
            if upto - under > inversions.total / 2:
                # Two often repeated slopes, say, with the rank near their border: cut between them.
                cut = (bottom + top) / 2
                at_cut = self._below(cut)
                low, high, below = (low, cut, below) if rank < at_cut else (cut, high, at_cut)
                continue
            if rank < under:
                high = left
            elif rank >= upto:
                low, below = right, upto
            else:
                low, high, below = left, right, under
