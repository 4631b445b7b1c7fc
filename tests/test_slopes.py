"""Slopes by rank against the list of all pairs."""

import numpy as np
import pytest

from levelcast.operators import slopes
from levelcast.operators.slopes import PairwiseSlopes


def listed(x, y):
    i, j = np.triu_indices(len(x), 1)
    apart = x[j] != x[i]
    return np.sort((y[j] - y[i])[apart] / (x[j] - x[i])[apart])


def points(kind, n, rng):
    x = np.sort(rng.integers(0, rng.choice([5, 60, 10**6]), n)).astype(float)
    y = {
        "random": rng.normal(size=n),
        "falling": np.round(90 - 0.01 * x + rng.normal(size=n), 1),
        "constant": np.zeros(n),
        "tied": rng.integers(0, 3, n).astype(float),
        "line": 3.0 - x / 4,
    }[kind]
    return x, y


@pytest.mark.parametrize("kind", ["random", "falling", "constant", "tied", "line"])
def test_any_rank_equals_the_list_of_pairs(kind, monkeypatch):
    monkeypatch.setattr(slopes, "LISTED_PER_POINT", 1)
    rng = np.random.default_rng(len(kind))
    for n in (3, 17, 120, 350):
        x, y = points(kind, n, rng)
        want, found = listed(x, y), PairwiseSlopes(x, y, listed=50)
        assert found.count == len(want)
        for rank in {0, len(want) // 50, len(want) // 3, len(want) // 2, len(want) - 1} if len(want) else ():
            assert found.at_rank(rank) == pytest.approx(want[rank], rel=1e-12, abs=1e-12)


def test_inversions_are_listed_once_each():
    ranks = np.random.default_rng(2).permutation(90)
    inversions = slopes._Inversions(ranks)
    a, b = inversions.pairs(np.arange(inversions.total))
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if ranks[i] > ranks[j]}
    assert len(a) == len(want) and set(zip(a.tolist(), b.tolist())) == want


def test_twelve_million_pairs_are_never_held(monkeypatch):
    rng = np.random.default_rng(7)
    x = np.sort(rng.integers(0, 40_000, 5000)) / 12.0
    y = np.round(95 - 0.02 * x + rng.normal(size=5000), 1)
    most, pairs = [0], slopes._Inversions.pairs

    def counted(self, numbers):
        most[0] = max(most[0], len(numbers))
        return pairs(self, numbers)

    monkeypatch.setattr(slopes._Inversions, "pairs", counted)
    found = PairwiseSlopes(x, y)
    middle = found.count // 2
    got, want = found.at_ranks([middle - 1, middle, 1000]), listed(x, y)
    assert got == pytest.approx([want[middle - 1], want[middle], want[1000]], rel=1e-12)
    assert most[0] <= 16 * 5000 and found.count > 12_000_000


def test_no_two_times_no_slope():
    assert PairwiseSlopes(np.full(40, 3.0), np.arange(40.0)).count == 0
