"""Blocks of ranges against a plain list."""

import random

import pytest

from tapeloom.operators.ranges import RangeBlocks


class Counting(dict):
    """A mapping that counts what is read from it."""

    reads = 0

    def get(self, key):
        self.reads += 1
        return self[key]


@pytest.mark.parametrize("seed", range(12))
def test_against_a_list(seed):
    rng, store, directory, plain = random.Random(seed), {}, b"", []
    width, reach = rng.choice([1, 2, 4, 7]), rng.choice([60, 4000])
    for _ in range(1500):
        if rng.random() < 0.05:  # a new batch starts from what was stored
            directory = ranges.directory() if "ranges" in locals() else b""
            ranges = RangeBlocks(store, directory, width)
        elif "ranges" not in locals():
            ranges = RangeBlocks(store, directory, width)
        start = rng.randrange(reach)
        end = start + rng.choice([1, 3, 9, 200])
        clash = any(a < end and b > start for a, b in plain)
        assert ranges.meets(start, end) == clash
        if not clash:
            ranges.add(start, end)
            plain.append((start, end))
        if plain and rng.random() < 0.4:
            ranges.remove(*plain.pop(rng.randrange(len(plain))))
    ranges.directory()
    assert set(store) == set(ranges.numbers) and len(ranges.numbers) <= max(1, len(plain))


def test_a_record_opens_only_its_neighbours():
    store = Counting()
    ranges = RangeBlocks(store)
    for k in range(100_000):
        ranges.add(2 * k, 2 * k + 1)
    again, store.reads = RangeBlocks(store, ranges.directory()), 0
    assert again.meets(50_001, 50_003) and not again.meets(50_001, 50_002)
    again.add(50_001, 50_002)
    again.remove(70_000, 70_001)
    assert store.reads == 2 and len(again.numbers) < 1000
