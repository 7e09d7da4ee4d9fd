"""Neighbours looked up by lanes of 16 bits, without Spark: equal to brute force, few pairs compared."""

import numpy as np
import pytest

from rootgraph.functions import blocks


def found(ids, words, asked, k, bits):
    width = 4
    cells = np.stack([np.bitwise_count(words & np.uint64(0xFFFFFFFF)).sum(axis=1), np.bitwise_count(words >> np.uint64(32)).sum(axis=1)], axis=1).astype(int) // width
    got, compared = blocks.nearest(ids[asked], words[asked], cells[asked], ids, words, cells, width * words.shape[1], k, 16 * (k + 1))
    out = {}
    for rows, at, s in got:
        for i, j, x in zip(rows, at, s, strict=True):
            out.setdefault(i, []).append((ids[j], x))
    return out, sum(compared)


def brute(ids, words, asked, k):
    out = {}
    for i, q in enumerate(asked):
        both, either = (np.bitwise_count(f(words, words[q])).sum(axis=1) for f in (np.bitwise_and, np.bitwise_or))
        s = np.divide(both, either, out=np.zeros(len(ids)), where=either > 0)
        out[i] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return out


@pytest.mark.parametrize(("bits", "n_words", "k"), [(16, 1, 3), (32, 1, 20), (48, 1, 5), (64, 1, 10), (30, 2, 4)])
def test_lanes_lose_nothing(monkeypatch, bits, n_words, k):
    """Sparse, dense, empty and equal fingerprints, keys in no order; lanes are used for few rows too and left at all costs."""
    monkeypatch.setattr(blocks, "FROM", 50)
    r = np.random.default_rng(bits)
    words = r.integers(0, 1 << bits, (600, n_words), dtype=np.uint64) if bits < 64 else r.integers(0, 1 << 63, (600, 1), dtype=np.uint64) * np.uint64(2)
    words[::7] &= r.integers(0, 1 << min(bits, 20), (86, n_words), dtype=np.uint64)
    words[::41] = 0
    words[5::9] = words[4]
    ids = r.permutation(5000)[:600]
    asked = r.permutation(600)[:200]
    want = brute(ids, words, asked, k)
    for run in (0.5, 8, 1e6):
        monkeypatch.setattr(blocks, "RUN", run)
        got, _ = found(ids, words, asked, k, bits)
        assert got == want


def test_rows_of_the_same_key_do_not_count(monkeypatch):
    monkeypatch.setattr(blocks, "FROM", 50)
    r = np.random.default_rng(1)
    words, ids = r.integers(0, 1 << 20, (300, 1), dtype=np.uint64), r.integers(0, 90, 300)
    words[100:200] = words[:100]
    asked = np.arange(0, 300, 3)
    assert {i: [s for _, s in x] for i, x in found(ids, words, asked, 4, 20)[0].items()} == {i: [s for _, s in x] for i, x in brute(ids, words, asked, 4).items()}


def test_few_pairs_are_compared():
    """32 bits without structure, of which bounds by bit counts leave out next to nothing; and many equal queries."""
    r = np.random.default_rng(2)
    words, ids = r.integers(0, 1 << 32, (30000, 1), dtype=np.uint64), np.arange(30000)
    asked = np.arange(0, 30000, 300)
    got, compared = found(ids, words, asked, 3, 32)
    assert got == brute(ids, words, asked, 3)
    assert compared < 0.1 * len(asked) * len(ids)
    words[:5000] = words[0]
    got, compared = found(ids, words, np.arange(2000), 3, 32)
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0)] and got[1999] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert compared < 2 * len(ids)
