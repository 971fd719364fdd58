"""The plan of packing is made on the driver: what it holds there stays small, however many lengths and sequences there are."""

import tracemalloc

import numpy as np
import pytest

from factledger.llm import packing

MB = 1 << 20


@pytest.fixture
def count():
    """Pieces of about 2000 lengths."""
    lengths = np.random.default_rng(1).lognormal(6.0, 0.9, 300_000).astype(int)
    return np.bincount(np.clip(lengths, 1, packing.CAPACITY), minlength=packing.CAPACITY + 1)


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_long_path_of_fillings(count):
    best, bins = packing.best_fit(count, packing.CAPACITY)
    goal = packing.least(count, packing.CAPACITY)
    found, most = peak(lambda: packing.complete(count, packing.CAPACITY, best, bins, goal, packing.STEPS))
    assert sum(p.times for p in found) == goal < bins
    used = sum(p.times * np.bincount(p.lengths, minlength=len(count)) for p in found)
    assert used.tolist() == count.tolist() and most < 32 * MB  # 292 MB with all sums held


def test_columns_of_many_lengths(count):
    (found, lengths, _), most = peak(lambda: packing.columns(count, packing.CAPACITY, [1e8]))
    made = np.zeros(len(count))
    for used, own, x in found:
        made[lengths[used]] += own * x
    assert np.allclose(made, count) and most < 64 * MB  # 101 MB with fillings held as a matrix


def test_places_that_are_left_and_found_again(monkeypatch):
    """Held or made again, a place yields the same fillings."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        count = np.bincount(rng.integers(1, 11, rng.integers(4, 16)), minlength=12)
        plans = []
        for held in (1, 2, 1000):
            monkeypatch.setattr(packing, "HELD", held)
            plans.append(packing.complete(count, 11, *packing.best_fit(count, 11), packing.least(count, 11), 50_000))
        assert plans[0] == plans[1] == plans[2]
