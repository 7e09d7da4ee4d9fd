"""Packing, sharding and suffix order against plain versions."""

import numpy as np

from rootgraph.llm.packing import best_fit, plan, reduce_dominated
from rootgraph.llm.sharding import greedy, minimax
from rootgraph.llm.suffixes import suffix_array


def test_plan_places_every_item_once():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = {int(s): int(rng.integers(1, 30)) for s in rng.integers(1, 101, 20)}
        runs = plan(counts, 100)
        full: dict[int, int] = {}
        for size, lo, hi, seq, at in runs.tolist():
            for k in range(hi - lo):
                full[seq + k] = full.get(seq + k, 0) + size
                assert at + size <= 100
        assert sum(full.values()) == sum(s * n for s, n in counts.items())
        assert max(full.values()) <= 100
        left = dict(counts)
        fixed = reduce_dominated(left, 100)
        fixed += best_fit(left, 100)
        assert sum(n for _, n in fixed) == len(full)


def test_minimax_is_least():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 50, 30).tolist()
        capacity, _ = minimax(sizes, 8)
        assert greedy(sizes, capacity, 8) is not None
        assert capacity == max(sizes) or greedy(sizes, capacity - 1, 8) is None


def test_suffix_array_sorts():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        t = rng.integers(97, 100, n).astype(np.uint8)
        b = t.tobytes()
        got = [b[i : i + 50] for i in suffix_array(t).tolist()]
        assert got == sorted(b[i : i + 50] for i in range(n))
