"""The library screen: faults, reruns, single classes."""

import os

import pytest
from pyspark.sql import functions as F

from jobs import library_screen
from jobs.common import configured

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """A copy of the first vectors, and unsound ones."""
    path = str(tmp_path_factory.mktemp("in") / "embeddings")
    good = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 120").select("vec_id", "label", "embedding")
    v = F.col("embedding")
    bad = good.where("vec_id < 4").select(
        F.when(F.col("vec_id") > 0, F.col("vec_id") + 9000).alias("vec_id"),
        F.when(F.col("vec_id") > 1, F.col("label")).alias("label"),
        F.when(F.col("vec_id") == 1, F.slice(v, 1, 9)).when(F.col("vec_id") == 2, F.transform(v, lambda x, i: F.when(i == 5, float("nan")).otherwise(x))).when(F.col("vec_id") == 3, F.lit(None)).otherwise(v).alias("embedding"),
    )
    good.withColumn("label", F.when(F.col("vec_id") % 17 > 0, F.col("label"))).unionByName(bad).write.parquet(path)
    return path


def read(spark, output):
    return sorted(map(tuple, library_screen.neighbours(spark, output).collect()), key=repr)


def test_reruns_and_single_classes_leave_the_same_table(spark, source, tmp_path):
    config = library_screen.Config(source, str(tmp_path / "out"), k=4)
    done = library_screen.run(spark, config)
    assert (done["rows"], done["rejected"], done["neighbours"]) == (124, 4, 480)
    assert 0 < done["pairs_compared"] <= 120 * 119
    faults = {r.vec_id: r.fault for r in spark.read.parquet(f"{config.output}/rejected").collect()}
    assert faults == {None: "no id", 9001: "too short", 9002: "not finite", 9003: "too short"}
    first = read(spark, config.output)
    library_screen.run(spark, config)
    assert read(spark, config.output) == first
    label = next(r[-1] for r in first if r[-1] is not None)
    one = library_screen.Config(source, config.output, k=4, classes=[label])
    assert library_screen.run(spark, one)["neighbours"] == sum(r[-1] == label for r in first)
    assert read(spark, config.output) == first
    classes = spark.read.parquet(f"{config.output}/classes")
    assert classes.agg(F.sum("n_queries")).first()[0] == 120 and classes.where("label is null").count() == 1
    by_hand = [r for r in first if r[-1] == label]
    row = classes.where(F.col("label") == label).first()
    assert row.same_class_fraction == pytest.approx(sum(r[6] for r in by_hand) / len(by_hand))


def test_settings(spark, source, tmp_path):
    with pytest.raises(ValueError):
        configured(library_screen.Config, {"source": "x", "output": "y", "bitz": 3})
    with pytest.raises(ValueError):
        library_screen.run(spark, library_screen.Config(source, str(tmp_path), k=0))
