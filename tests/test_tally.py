"""Pairs counted by cells of equal bit counts, and rows that stand for several, without Spark."""

from collections import Counter

import numpy as np
import pytest

from rootgraph.functions import blocks


def brute(a, b, couple, differ, same, times):
    out = Counter()
    for i in range(len(times[0])):
        for j in range(i if same else 0, len(times[1])):
            s = []
            for c in couple:
                u, v = int(a[c][i, 0]), int(b[c][j, 0])
                s.append(bin(u & v).count("1") / bin(u | v).count("1") if u | v else 0.0)
            if not differ or a[differ][i, 0] != b[differ][j, 0]:
                out[tuple(s)] += int(times[0][i] * (times[0][i] - 1) // 2 if same and i == j else times[0][i] * times[1][j])
    return {k: n for k, n in out.items() if n}


@pytest.mark.parametrize("many", [0, 1 << 40])
@pytest.mark.parametrize("slab", [50, 1 << 20])
@pytest.mark.parametrize("differ", [None, "x", "y"])
def test_counts_are_those_of_each_pair(monkeypatch, many, slab, differ):
    monkeypatch.setattr(blocks, "MANY", many)
    monkeypatch.setattr(blocks, "SLAB", slab)
    r = np.random.default_rng(5)
    bits = {"x": 6, "y": 9}
    side = lambda n: ({c: r.integers(0, 1 << k, (n, 1), dtype=np.uint64) for c, k in bits.items()}, r.choice([1, 1, 1, 2, 7], n))
    (a, p), (b, q) = side(70), side(90)
    for t in (a, b):
        t["x"][::5] = 3
        t["y"][::11] = 0
    for (u, n), (v, m), same in (((a, p), (b, q), False), ((b, q), (b, q), True), ((a, np.ones(70, np.int64)), (a, np.ones(70, np.int64)), True)):
        first, second, found = blocks.tally(u, v, bits, [("x", "y")], differ, same, (n, m))["x", "y"]
        assert dict(zip(zip(first, second, strict=True), found, strict=True)) == brute(u, v, ("x", "y"), differ, same, (n, m))


def test_copies_are_compared_once(spark, monkeypatch):
    from rootgraph.operators import similarity

    monkeypatch.setattr(similarity, "_by_blocks", lambda rows, *more: rows)
    d = spark.range(60).selectExpr("id", "array(id % 3) as x", "array(id % 2) as y")
    merged = similarity.tallied(d, "id", {"x": 2, "y": 1}, [("x", "y")])
    assert {(r.x[0], r.y[0], r._times[0]) for r in merged.collect()} == {(i, j, 10) for i in range(3) for j in range(2)}
