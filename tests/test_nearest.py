"""The bit-count index against brute force."""

import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rootgraph.operators import nearest as index
from rootgraph.operators import similarity
from rootgraph.plans import catalog
from rootgraph.plans.fixtures import signs


def tanimoto(a, b):
    mask = (1 << 64) - 1
    both = sum(bin(x & y & mask).count("1") for x, y in zip(a, b, strict=True))
    either = sum(bin((x | y) & mask).count("1") for x, y in zip(a, b, strict=True))
    return both / either if either else 0.0


def brute(queries, library, k):
    """{(group, query): [(match, similarity)...]} of rows (group, key, words)."""
    out = {}
    for g, q, w in queries:
        if w is None:
            continue
        near = sorted((-tanimoto(w, x), m) for h, m, x in library if h == g and m != q and x is not None)[:k]
        if near:
            out[g, q] = [(m, -s) for s, m in near]
    return out


def collected(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault((r.g, r.query), []).append((r.match, r.similarity))
    return out


def rows(n, bits, seed):
    """Sparse and dense fingerprints, many equal ones, empty and null ones, one large group."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        full = bits if r.random() < 0.5 else bits // 6
        on = r.sample(range(bits), r.randrange(full)) if i % 10 else range(7)
        w = [sum(1 << (b % 64) for b in on if b // 64 == j) for j in range(bits // 64)]
        w = [x - (1 << 64) if x >> 63 else x for x in w]
        out.append((0 if i % 4 else i % 3, i, None if i % 53 == 1 else [0] * len(w) if i % 29 == 0 else w))
    return out


@pytest.mark.parametrize("bits,parts,cells,block", [(64, 2, 512, 2048), (64, 1, 8, 7), (128, 4, 20, 16), (192, 3, 64, 5)])
def test_equals_brute_force(spark, monkeypatch, bits, parts, cells, block):
    monkeypatch.setattr(index, "ASKED", 40)
    data = rows(260, bits, bits + parts)
    df = spark.createDataFrame(data, "g int, id int, w array<bigint>")
    for k, first in ((3, 4), (300, None)):
        got = index.nearest(df.where("id % 3 = 0"), df, "id", "w", bits // 64, k, ["g"], parts, cells, block, first)
        assert collected(got) == brute([x for x in data if x[1] % 3 == 0], data, k)


def test_empty_sides_and_one_row(spark):
    df = spark.createDataFrame(rows(5, 64, 1), "g int, id int, w array<bigint>")
    for q, lib in ((df.where("false"), df), (df, df.where("false")), (df.where("id = 2"), df.where("id = 2"))):
        assert index.nearest(q, lib, "id", "w", 1, 3).count() == 0
    with pytest.raises(ValueError):
        index.nearest(df, df, "id", "w", 1, 3, parts=3)


def test_compares_less_than_all_pairs(spark):
    """Fingerprints of very different bit counts: most cells are never visited."""
    data = [(0, i, [(1 << (1 + i % 60)) - 1, (1 << (1 + i // 60 % 60)) - 1]) for i in range(1800)]
    df = spark.createDataFrame(data, "g int, id int, w array<bigint>")
    seen = Observation(), Observation()
    got = index.nearest(df.where("id % 20 = 0"), df, "id", "w", 2, 3, compared=seen).withColumn("g", F.lit(0))
    assert collected(got) == brute([x for x in data if x[1] % 20 == 0], data, 3)
    assert sum(s.get["n"] for s in seen) < 0.25 * 90 * 1800


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_registered_query_is_the_triangles_top(spark):
    sf = "/root/testdata/sf0.001"
    old = similarity.top_k(catalog.tanimoto_pairs(spark, sf), "similarity", 10).select("i", "rank", "j", "similarity")
    new = catalog.tanimoto_topk(spark, sf)
    assert new.exceptAll(old).count() == 0 and new.count() == old.count()
    lib = signs(spark, sf, words=(0, 64))
    seen = Observation(), Observation()
    index.nearest(lib, lib, "vec_id", "words", 1, 10, compared=seen).write.format("noop").mode("overwrite").save()
    n = lib.count()
    assert sum(s.get["n"] for s in seen) < n * (n - 1)


def test_block_of_copies_needs_few_pairs_at_once(monkeypatch):
    """Many equal fingerprints, and no more than 40 pairs held at once: ties still go to the smaller ids."""
    import numpy as np

    from rootgraph.functions import blocks

    monkeypatch.setattr(blocks, "SLAB", 40)
    r = random.Random(3)
    words = np.array([[r.choice([7, 7, 7, 0, r.getrandbits(64)]), 5] for _ in range(150)], np.uint64)
    ids = np.array(r.sample(range(1000), 150))
    cells = np.bitwise_count(words).astype(int) // 4
    found, compared = blocks.nearest(ids[:60], words[:60], cells[:60], ids, words, cells, 4, 5, 8)
    got = {}
    for rows, at, s in found:
        for i, j, x in zip(rows, at, s, strict=True):
            got.setdefault((0, ids[i]), []).append((ids[j], x))
    data = [(0, i, [int(x) for x in w]) for i, w in zip(ids, words, strict=True)]
    assert got == brute(data[:60], data, 5) and 0 < sum(compared) <= 60 * 149
