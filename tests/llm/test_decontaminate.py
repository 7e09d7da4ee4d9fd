"""The join of a large benchmark gives what one index gives."""

import os

import pytest
from pyspark.sql import functions as F

from rootgraph.llm import decontaminate

SF = "/root/testdata/sf0.001"


def same(docs, benchmark, width=decontaminate.WINDOW):
    a = decontaminate.decontaminate(docs, benchmark, width)
    b = decontaminate.decontaminate(docs, benchmark, width, most=0)
    assert b.columns == a.columns
    rows = sorted(map(tuple, a.collect()), key=repr)
    assert rows == sorted(map(tuple, b.collect()), key=repr)
    return rows


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_whole_tables(spark):
    """All documents against the given benchmark and against passages of the documents themselves, many of them shared."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("d"), F.col("doc_id")).alias("item_id"), "text")
    rows = same(docs, spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").cast("string").alias("item_id"), "text").union(own))
    assert sum(r[-1] for r in rows) > docs.count() // 3


def test_awkward_rows(spark, docs, none):
    texts = [("a", "one"), ("b", "word3 stone3 river"), ("c", None), ("d", "!!"), (None, "word20 stone6 river word21"), ("a", "one"), ("e", "plain text"), ("f", " ".join(f"w{i}" for i in range(29_980, 30_000)))]
    texts += [(f"many{i}", f"common words common words common words common words common words {i}") for i in range(40)]
    bench = spark.createDataFrame(texts, "item_id string, text string").withColumn("at", F.lit(1))
    hot = spark.createDataFrame([(100 + i, "common words " * 50 + str(i)) for i in range(30)], "doc_id long, text string")
    more = docs.select("doc_id", "text").union(hot).withColumn("row", F.lit("x")).repartition(3)
    for width in (10, 2):
        rows = same(more, bench, width)
        assert len(rows) == more.count() and any(r[2] for r in rows)
    assert same(none, bench) == []
    assert not any(r[-1] for r in same(more, bench.where("false")))
