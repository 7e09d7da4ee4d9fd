"""The descriptor feed: growing input, repeats, failures, and its command line."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import path_feed
from rootgraph.functions import texts
from rootgraph.operators import graph, metrics

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return sorted(map(tuple, df.drop("batch").collect()), key=repr)


@pytest.fixture
def place(tmp_path):
    return path_feed.Config(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), 256, 2)


def add(spark, config, some):
    spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(config.source)


ONE = [(1, "one two three", "en", "a", 13), (2, None, "en", "a", 0), (3, "  ", None, "b", 2), (4, "!?", "fr", None, 2)]
TWO = [(5, "Un deux trois un deux", "fr", "b", 21), (6, "word " * 3000, "en", "a", 15000), (1, "one two three", "en", "a", 13)]


def test_takes_only_what_is_new(spark, place):
    add(spark, place, ONE)
    assert path_feed.run(spark, place) == {"batches": 1, "rows": 4}
    first = rows(path_feed.descriptors(spark, place.output))
    assert [r[2] for r in sorted(first, key=lambda r: r[0])] == ["ok", "blank", "blank", "no words"]
    assert path_feed.run(spark, place) == {"batches": 0, "rows": 0}
    add(spark, place, TWO)
    assert path_feed.run(spark, place) == {"batches": 1, "rows": 3}
    all_rows = rows(path_feed.descriptors(spark, place.output))
    want = path_feed.described(spark.createDataFrame(ONE + TWO, SCHEMA), place)
    assert all_rows == rows(want) and all(r in all_rows for r in first)
    # the report from the counts is that of the whole table
    got = {(r.lang, r.source): r for r in path_feed.density(spark, place.output, place.n_bits).collect()}
    for r in metrics.bit_density(want.where("status = 'ok'"), ["lang", "source"], "on_bits", place.n_bits).collect():
        mine = got.pop((r.lang, r.source))
        assert (mine.n_structures, mine.mean_on_bits, mine.std_on_bits, mine.mean_bit_density) == pytest.approx((r.n_structures, r.mean_on_bits, r.std_on_bits, r.mean_bit_density))
    assert not got


def test_a_repeated_batch_replaces_what_it_wrote(spark, place):
    add(spark, place, ONE)
    add(spark, place, TWO)
    small = path_feed.Config(place.source, place.output, place.checkpoint, 256, 2, files_at_once=1)
    assert path_feed.run(spark, small) == {"batches": 2, "rows": 7}
    before = rows(path_feed.descriptors(spark, place.output)), rows(path_feed.counts(spark, place.output))
    for name in ("1", ".1.crc"):  # as if the run had been lost after it wrote and before it was committed
        if os.path.exists(f"{place.checkpoint}/commits/{name}"):
            os.remove(f"{place.checkpoint}/commits/{name}")
    assert path_feed.run(spark, small)["batches"] == 1
    assert (rows(path_feed.descriptors(spark, place.output)), rows(path_feed.counts(spark, place.output))) == before
    with pytest.raises(ValueError):
        path_feed.run(spark, path_feed.Config("a", "b", "c", files_at_once=0))


def test_bits_are_those_of_a_chain_as_a_graph_row(spark):
    docs = spark.createDataFrame([(0, "a b a b c"), (1, "x"), (2, ""), (3, "Same same SAME other")], "g int, text string")
    words = docs.select("g", F.posexplode(texts.words(F.col("text"))).alias("k", "w"))
    nodes = words.select("g", (F.col("k") + 1).alias("id"), F.col("w").alias("invariant"), F.lit(False).alias("is_root"))
    nodes = nodes.unionByName(docs.select("g", F.lit(0).alias("id"), F.lit("-").alias("invariant"), F.lit(True).alias("is_root")))
    bonds = words.select("g", F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.lit("single").alias("type"), F.lit(False).alias("ring"))
    rooted = graph.rooted(graph.build(nodes, bonds))
    want = {r.g: r.b for r in graph.path_fingerprint(rooted, 3, 512).groupBy("g").agg(F.array_sort(F.collect_list("bit")).alias("b")).collect()}
    for r in texts.with_chain_bits(docs, "text", 512, 3).collect():
        assert r.on_bits == want.get(r.g, [])
    with pytest.raises(graph.GraphError):
        texts.with_chain_bits(docs, "text", 512, 0)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_command_line(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"source": f"{SF}/documents.parquet", "output": "replaced", "checkpoint": str(tmp_path / "checkpoint")}))
    call = [sys.executable, "-m", "jobs.path_feed", "--config", str(tmp_path / "config.json"), "--set", f"output={tmp_path / 'out'}", "max_edges=1"]
    said = [subprocess.run(call, cwd=ROOT, capture_output=True, text=True, timeout=240) for _ in range(2)]
    assert [s.returncode for s in said] == [0, 0], said[0].stderr[-2000:]
    told = [json.loads(line.partition(" jobs ")[2]) for s in said for line in s.stderr.splitlines() if " jobs {" in line]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [t["rows"] for t in told if t["event"] == "path_feed"] == [n, 0]
    assert path_feed.descriptors(spark, str(tmp_path / "out")).count() == n


def test_texts_of_one_file_are_dealt_over_tasks(spark, place, monkeypatch):
    monkeypatch.setattr(path_feed, "ROWS", 1)
    add(spark, place, [(i, f"word {i} of many", "en", "a", 14) for i in range(40)])
    assert path_feed.run(spark, place) == {"batches": 1, "rows": 40}
    tasks = path_feed.descriptors(spark, place.output).select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).distinct().count()
    assert tasks > 10
