"""The inverted multi-index on links at the threshold beside a hot label, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootgraph.llm import embeddings


def at_cosine(r, x, low, high):
    """A vector at a random cosine to x."""
    c = r.uniform(low, high)
    y = r.normal(size=len(x))
    y -= (y @ x) * x / (x @ x)
    return c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * y / np.linalg.norm(y)


def brute(rows):
    n, seen = {i: 0 for i, _, _ in rows}, {}
    for label in {label for _, label, _ in rows}:
        own = [(i, v) for i, k, v in rows if k == label]
        x = np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = x @ x.T >= embeddings.THRESHOLD
        np.fill_diagonal(linked, False)
        for (i, _), row in zip(own, linked, strict=True):
            n[i], seen[i] = int(row.sum()), {own[j][0] for j in np.flatnonzero(row)}
    return n, seen


@pytest.mark.parametrize("d,hot", [(64, 1500), (32, 0)])
def test_links_have_two_ends_and_few_are_missed(spark, d, hot):
    r, rows = np.random.default_rng(d), []
    for k in range(2000):
        x = r.normal(size=d)
        rows += [(2 * k, 1 + k % 3, x), (2 * k + 1, 1 + k % 3, at_cosine(r, x, 0.9802, 0.985))]
    centre = r.normal(size=d)
    rows += [(10_000 + i, 0, centre + 0.02 * r.normal(size=d)) for i in range(hot)]
    df = spark.createDataFrame([(i, label, [float(v) for v in x]) for i, label, x in rows], "vec_id long, label int, embedding array<double>")
    got = {x.vec_id: x for x in embeddings.near_duplicates(df.withColumn("home", F.lit("x")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2)).repartition(7)).collect()}
    want, seen = brute(rows)
    total = sum(want.values())
    assert all(got[i].n_links <= n for i, n in want.items())
    pairs = [(2 * k, 2 * k + 1) for k in range(2000) if want[2 * k] == want[2 * k + 1] == 1]
    assert all(got[a].n_links == got[b].n_links for a, b in pairs)
    assert sum(got[a].n_links for a, _ in pairs) >= 0.998 * len(pairs)
    assert sum(x.n_links for x in got.values()) >= 0.998 * total
    joined = [(a, b) for a, b in pairs if got[a].n_links]
    assert all(got[b].component_id == a and not got[b].kept for a, b in joined)
    assert len({got[i].component_id for i in got if i >= 10_000}) == (1 if hot else 0)


def test_repeated_rows_and_empty_tables(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(1, 0, v), (1, 0, v), (2, 0, [2.0, 4.0, 6.0, 8.1]), (3, None, v), (4, 0, v[:2])], "vec_id long, label int, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
    assert embeddings.near_duplicates(df.where("false")).count() == 0
