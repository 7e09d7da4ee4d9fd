"""Quantiles, ranks, running sums, bootstrap and mixtures with limits so small that every group counts as large."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootgraph.operators import metrics, mixtures, quantiles, stats
from rootgraph.sources import shared

P = {"q0": 0.0, "q25": 0.25, "median": 0.5, "q90": 0.9, "q100": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    """Groups of all sizes, one hot value, one value only, wide exponents, nulls, a null group."""
    r = random.Random(5)
    rows = [("mixed", r.choice([0.0, 0.0, 0.0, round(r.gauss(0, 1), 2), r.gauss(0, 5)])) for _ in range(700)]
    rows += [("wide", r.choice([-1, 1]) * 10.0 ** r.randrange(-200, 200)) for _ in range(150)]
    rows += [("same", 3.5)] * 90 + [("one", 1.25), ("two", 1.0), ("two", 2.0), ("none", None), ("mixed", None)]
    rows += [(None, float(i * i % 101)) for i in range(300)]
    return spark.createDataFrame(rows, "g string, v double").repartition(6)


def test_quantiles_by_selection(spark, values, monkeypatch):
    wanted = {k: ("v", p) for k, p in P.items()}
    got = {r.g: [r[k] for k in P] for r in quantiles.quantiles(values, ["g"], wanted, few=8).collect()}
    held = {}
    for r in values.collect():
        held.setdefault(r.g, []).extend([] if r.v is None else [r.v])
    assert set(got) == set(held)
    for g, v in held.items():
        assert got[g] == (pytest.approx(np.quantile(v, list(P.values())), rel=1e-12) if v else [None] * len(P))
    every = [x for v in held.values() for x in v]
    assert list(quantiles.quantiles(values, [], wanted, few=8).first()) == pytest.approx(np.quantile(every, list(P.values())), rel=1e-12)
    # the same beside other aggregates, and with small sides that are salted, not broadcast
    monkeypatch.setattr(shared, "SMALL", 0)
    a = quantiles.summary(values, ["g"], [F.count("v").alias("n")], wanted, few=8)
    b = quantiles.summary(values, ["g"], [F.count("v").alias("n")], wanted)
    near = {r.g: list(r)[1:] for r in a.collect()}
    for r in b.collect():
        assert near.pop(r.g) == [x if x is None else pytest.approx(x, rel=1e-12) for x in list(r)[1:]]
    assert not near


def test_summaries_do_not_depend_on_the_limit(spark, values):
    v = values.where("g is not null and v is not null and g <> 'wide'")
    for f in (lambda few: metrics.distances(v, ["g"], "v", few), lambda few: stats.boxplot(v, ["g"], "v", few), lambda few: stats.histogram_fd(v, "v", few), lambda few: stats.matched_report(v, "v", few)):
        a, b = (sorted(f(few).collect(), key=str) for few in (8, 10**6))
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert [z if z is None or isinstance(z, str) else pytest.approx(z, rel=1e-9) for z in y] == list(x)


def ranks(v):
    order = sorted(v)
    return [np.mean([i + 1 for i, x in enumerate(order) if x == y]) for y in v]


def test_one_large_group_is_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(shared, "SMALL", 3)
    r = random.Random(2)
    data = [("a" if i % 5 else "b", r.choice([0.0, 0.0, 0.5, r.random()]), round(r.random(), 1)) for i in range(400)]
    data += [("c", 0.1, float(i)) for i in range(3)]
    df = spark.createDataFrame([*data, ("a", None, 1.0)], "g string, x double, y double").repartition(5)
    for few in (10, 10**6):
        got = {r.g: r for r in metrics.agreement(df, "x", "y", ["g"], few).collect()}
        for g in "ab":
            x, y = ([row[i] for row in data if row[0] == g] for i in (1, 2))
            assert got[g].n_pairs == len(x)
            assert got[g].pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
            assert got[g].spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
        assert got["c"].spearman is None and got["c"].pearson is None
    runs = quantiles.running(spark.range(1000).withColumn("g", F.col("id") % 3), ["g"], ["id"], F.col("id"), "before", few=10)
    assert {(r.id, r.before) for r in runs.collect()} == {(i, sum(range(i % 3, i, 3))) for i in range(1000)}


def test_bootstrap_is_that_of_repeated_rows(spark):
    r = random.Random(9)
    rows = [(g, f"c{r.randrange(9 if g else 25):02d}", r.choice([0.0, 0.25, round(r.gauss(0, 1), 3)])) for g in (0, 1) for _ in range(500)]
    rows += [(1, "c00", 7.0)] * 400 + [(1, "c03", None)]
    df = spark.createDataFrame(rows, "g int, cluster string, v double")
    n = df.where("v is not null").groupBy("g").agg(F.count_distinct("cluster").alias("n"))
    draws = stats.hashed_draws(n, ["g"], 40, 3).persist()
    names = {g: sorted({c for h, c, v in rows if h == g and v is not None}) for g in (0, 1)}
    held = {}
    for g, c, v in rows:
        held.setdefault((g, c), []).extend([] if v is None else [v])
    drawn = {}
    for d in draws.collect():
        drawn.setdefault((d.g, d.replicate), []).extend(held[d.g, names[d.g][d.ordinal]])
    for exact in (5, 256):
        got = {(x.g, x.statistic): x for x in stats.cluster_bootstrap(df, "cluster", "v", draws, ["g"], few=30, exact=exact).collect()}
        assert len(got) == 4
        for (g, name), x in got.items():
            f = np.mean if name == "mean" else np.median
            reps = [f(v) for (h, _), v in drawn.items() if h == g]
            whole = [v for h, _, v in rows if h == g and v is not None]
            assert (x.estimate, x.standard_error, x.ci_95_lower, x.ci_95_upper, x.n_replicates) == pytest.approx((f(whole), np.std(reps, ddof=1), *np.quantile(reps, [0.025, 0.975]), 40))


def plain_em(x, model, rounds):
    w, m, v = (np.array(p, float) for p in model)
    for _ in range(rounds):
        p = w * np.exp(-((x[:, None] - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)
        r = p / p.sum(axis=1, keepdims=True)
        n = r.sum(axis=0)
        w, m = n / len(x), (r * x[:, None]).sum(axis=0) / n
        v = (r * (x[:, None] - m) ** 2).sum(axis=0) / n
    return np.log((w * np.exp(-((x[:, None] - m) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v)).sum(axis=1)).sum(), m


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_mixtures_reach_what_plain_maximisation_reaches(spark):
    """Two clear populations of a table's values, with repeats: the optimum that EM in memory reaches, and its assignments."""
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    d = o.select("o_orderkey", F.round(F.col("o_totalprice") / 1e5 + F.when(F.col("o_orderkey") % 3 == 0, 12).otherwise(0), 1).alias("d"))
    x = np.array([r.d for r in d.collect()])
    out = mixtures.mixtures(d, "o_orderkey", "d", (1, 2), 2, few=50)
    got = {r.n_components: r for r in out["model_comparison"].collect()}
    like = -len(x) / 2 * (math.log(2 * math.pi * x.var()) + 1)
    assert got[1].aic == pytest.approx(4 - 2 * like, rel=1e-5) and got[1].bic == pytest.approx(2 * math.log(len(x)) - 2 * like, rel=1e-5)
    like, means = plain_em(x, ([0.5, 0.5], [x.min(), x.max()], [x.var() / 4] * 2), 300)
    assert got[2].aic == pytest.approx(10 - 2 * like, rel=1e-3)
    parts = out["component_summary"].orderBy("component").collect()
    assert [p.fitted_mean for p in parts] == pytest.approx(sorted(means), rel=1e-2)
    assert sum(p.n_assigned for p in parts) == len(x) and parts[0].component == 1
    for p in parts:
        own = [r.d for r in out["assignments"].where(F.col("component") == p.component).collect()]
        assert (p.assigned_mean, p.assigned_median) == pytest.approx((np.mean(own), np.median(own)))
    assert out["assignments"].where("assignment_probability < 0.5 or assignment_probability > 1").count() == 0


def test_mixtures_of_awkward_values(spark):
    same = spark.createDataFrame([(i, 2.0) for i in range(5)], "k int, v double")
    assert mixtures.mixtures(same, "k", "v", (1, 2), 2, starts=2)["assignments"].count() == 5
    with pytest.raises(ValueError):
        mixtures.mixtures(same.withColumn("v", F.lit(float("nan"))), "k", "v")
    with pytest.raises(ValueError):
        mixtures.mixtures(same, "k", "v", (1, 3), 2)
    with pytest.raises(ValueError):
        mixtures.mixtures(same.where("false"), "k", "v", (1, 2), 2)


def test_binned_density_is_within_its_bound(spark):
    r = random.Random(4)
    data = [(r.gauss(0, 1), r.choice([r.gauss(-3, 0.5), r.gauss(2, 1)])) for _ in range(1500)]
    df = spark.createDataFrame([*data, (None, 1.0)], "x double, y double")
    grid = [k / 2 for k in range(-8, 9)]
    a = np.array(data)
    exact = {(p.x, p.y): p.density for p in stats.kde_2d(df, "x", "y", grid, grid).collect()}
    h = a.std(axis=0, ddof=1) * len(a) ** (-1 / 6)
    for bins in (24, 200):
        d = (a.max(axis=0) - a.min(axis=0)) / (bins - 1)
        bound = sum(d * d / (8 * h * h)) / (2 * math.pi * h[0] * h[1])
        near = stats.kde_2d(df, "x", "y", grid, grid, bins).collect()
        assert len(near) == len(exact)
        assert max(abs(p.density - exact[p.x, p.y]) for p in near) <= bound
    with pytest.raises(ValueError):
        stats.kde_2d(df, "x", "y", grid, grid, 1)
    with pytest.raises(ValueError):
        stats.kde_2d(df.withColumn("y", F.lit(1.0)), "x", "y", grid, grid)
