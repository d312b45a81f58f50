"""Leaks at the allowed edits against brute-force edit distance, for items of all lengths."""

import numpy as np
import pytest

from reviewlake.llm import decontaminate


def _distance(item, region):
    """Least word edits between the item and any part of the region, cell by cell."""
    row = [0] * (len(region) + 1)
    for i, word in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, other in enumerate(region, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (word != other))
    return min(row)


def _edited(random, words, kinds, edits):
    words = list(words)
    for at in sorted(random.choice(len(words), edits, replace=False).tolist(), reverse=True):
        kind = kinds[int(random.integers(len(kinds)))]
        new = [f"new{random.integers(10**9)}"]
        words[at : at + 1] = {"delete": [], "insert": [words[at], *new], "change": new}[kind]
    return words


@pytest.mark.parametrize("kinds", [["delete"], ["insert"], ["change"], ["delete", "insert", "change"]])
@pytest.mark.parametrize("n", [20, 40, 80, 150, 300])
def test_every_leak_is_found(n, kinds):
    random = np.random.default_rng(n)
    k = decontaminate.edits_allowed(n)
    items, texts = [], []
    for i in range(12):
        item = [f"i{i}w{w}" for w in random.integers(0, 4 * n, n).tolist()]
        items.append((i, " ".join(item)))
        own = _edited(random, item, kinds, k if i < 9 else k + 3)
        texts.append([*(f"a{w}" for w in range(i)), *own, *(f"b{w}" for w in range(5))])
    want = {(i, i): e for i in range(12) if (e := _distance(items[i][1].split(), texts[i])) <= k}
    found = decontaminate.Index(items).matches(decontaminate.numbers([" ".join(t) for t in texts]))
    assert {(i, item): edits for i, item, edits, _ in found} == want and len(want) >= 9


def test_distance_in_bits():
    random = np.random.default_rng(3)
    for _ in range(300):
        n = int(random.integers(1, 90))
        item, region = (random.integers(0, 8, size).tolist() for size in (n, int(random.integers(0, 120))))
        if random.random() < 0.5:
            region[len(region) // 2 : len(region) // 2] = [w for w in item if random.random() < 0.9]
        most, real = int(random.integers(0, n + 1)), _distance(item, region)
        assert decontaminate.edit_distance(decontaminate.places(item), n, region, most) == min(real, most + 1)
