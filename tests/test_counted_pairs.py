"""Pairs that are counted or ranked in tasks against pairs as rows."""

import random

import pytest
from pyspark.sql import functions as F

from rootgraph.functions import blocks
from rootgraph.functions.bits import tanimoto
from rootgraph.operators import metrics, quantiles, similarity


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = [(i, r.choice("abc") if i % 17 else None, i % 2, [r.choice([3, r.getrandbits(8)])], [r.getrandbits(8)]) for i in range(90)]
    return spark.createDataFrame(data, "id long, label string, g int, x array<bigint>, y array<bigint>").repartition(3)


def as_rows(rows, group, apart, differ):
    p = similarity.pairs(rows, "id", group).where("x_i[0] <> x_j[0]" if differ else "true")
    p = p.where("label_i <> label_j") if apart else p
    low, high = (F.least("label_i", "label_j"), F.greatest("label_i", "label_j")) if apart else (F.lit(None).cast("string"),) * 2
    return p.select(*group, low.alias("low"), high.alias("high"), F.col("id_i").alias("i"), F.col("id_j").alias("j"), *(tanimoto(F.col(f"{c}_i"), F.col(f"{c}_j"), 1).alias(n) for c, n in (("x", "first"), ("y", "second"))))


@pytest.mark.parametrize(("group", "apart", "differ", "block"), [(["g"], "label", "x", 7), (["g"], "label", None, 1000), ([], None, None, 13), ([], None, "x", 1000)])
def test_counts_are_those_of_rows(spark, rows, monkeypatch, group, apart, differ, block):
    monkeypatch.setattr(blocks, "SLAB", 50)
    columns = [*group, "low", "high", "first", "second"]
    got = similarity.tallied(rows, "id", {"x": 8, "y": 8}, [("x", "y")], group, apart, differ, block).groupBy(*columns).agg(F.sum("n").alias("n"))
    want = as_rows(rows, group, apart, differ).groupBy(*columns).agg(F.count("*").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


@pytest.mark.parametrize("down", [True, False])
def test_first_pairs_are_those_of_rows(rows, down):
    gain = F.round(F.col("first") - F.col("second"), 9)
    top = lambda p: [tuple(r) for r in p.select("i", "j", gain.alias("gain")).orderBy(F.col("gain").desc() if down else "gain", "i", "j").limit(12).collect()]
    got = similarity.first_pairs(rows, "id", {"x": 8, "y": 8}, ("x", "y"), ["g"], "label", "x", 12, down, 9)
    assert top(got) == top(as_rows(rows, ["g"], "label", "x"))


def test_weighted_summaries_are_those_of_repeated_rows(spark):
    r = random.Random(8)
    data = [(r.choice("pq"), f"c{r.randrange(5)}", r.randrange(6) / 7, r.randrange(6) / 5, r.randrange(1, 9)) for _ in range(120)]
    once = spark.createDataFrame(data, "pair_group string, cluster_id string, base_distance double, alt_distance double, n long")
    each = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("k", "n")
    close = lambda a, b: [[x if x is None or isinstance(x, str) else pytest.approx(x) for x in row] for row in sorted(map(tuple, a.collect()), key=str)] == [list(row) for row in sorted(map(tuple, b.collect()), key=str)]
    for few in (3, 10**6):
        assert close(metrics.group_summary(once, ["base", "alt"], "base", few=few, weight="n"), metrics.group_summary(each, ["base", "alt"], "base"))
        assert close(metrics.agreement(once, "base_distance", "alt_distance", ["pair_group"], few, "n"), metrics.agreement(each, "base_distance", "alt_distance", ["pair_group"]))
        wanted = {"q": ("base_distance", 0.3)}
        assert close(quantiles.quantiles(once, ["pair_group"], wanted, few, "n"), quantiles.quantiles(each, ["pair_group"], wanted))
