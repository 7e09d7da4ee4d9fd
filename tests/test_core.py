"""Operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from rootgraph.functions import bits, smiles
from rootgraph.operators import graph, metrics, similarity, stats


@pytest.mark.parametrize(("text", "edges", "paths", "increments", "labels"), [("[Hg]CCO", 3, 6, 10, 15), ("[Hg]C1CC1", 5, 11, 19, 12), ("[Hg]CC(C)C", 4, 9, 16, 16)])
def test_structure_counts(spark, text, edges, paths, increments, labels):
    g = spark.createDataFrame([(1, text)], "g int, s string")
    g = graph.rooted(smiles.read_graphs(g, "s"))
    r = graph.with_paths(graph.refine(g, 3), 6)
    row = r.select(F.size("edges"), F.size("paths"), F.size(graph.path_bits(F.col("paths"), 1024)), F.size(F.array_distinct("features")), graph.violations(g)).first()
    assert row[:4] == (edges, paths, increments, labels)
    assert row[4] == []


def test_descriptors_do_not_depend_on_the_order_of_atoms(spark):
    same = [("[Hg]c1ccncc1O", "Oc1cnccc1[Hg]"), ("[Hg]CC(C)(Cl)C", "CC(C)(C[Hg])Cl"), ("[Hg]C1CCC1=O", "O=C1CCC1[Hg]")]
    g = spark.createDataFrame([(k, s) for k, pair in enumerate(same) for s in pair], "k int, s string")
    g = graph.with_paths(graph.wl_fingerprint(graph.rooted(smiles.read_graphs(g, "s")), 3, 256), 4)
    got = g.groupBy("k").agg(F.count_distinct("on_bits"), F.count_distinct(F.array_sort(graph.path_bits(F.col("paths"), 256))), F.count_distinct(smiles.canonical("s"))).collect()
    assert all(tuple(r)[1:] == (1, 1, 1) for r in got)


def test_fold_equals_plain_arithmetic(spark):
    import hashlib

    words = [f"w{i}" for i in range(20)]
    digest = F.sha2("w", 256)
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bits.fold(digest, 1024), bits.fold(digest, 1000), bits.fold(digest, 7)).collect()
    for w, *found in got:
        h = int(hashlib.sha256(w.encode()).hexdigest(), 16)
        assert found == [h % 1024, h % 1000, h % 7]


def test_tanimoto_of_packed_bits(spark):
    rows = [([1, 63, 64, 100], [1, 64, 99]), ([], []), ([5], [])]
    d = spark.createDataFrame(rows, "a array<int>, b array<int>")
    a, b = bits.pack(F.col("a"), 128), bits.pack(F.col("b"), 128)
    assert [r[0] for r in d.select(bits.tanimoto(a, b, 2)).collect()] == [2 / 5, 0.0, 0.0]
    assert d.select(bits.unpack(a, 128)).first()[0] == [1, 63, 64, 100]


def test_batches_are_balanced(spark):
    import numpy as np

    for n, size in ((10, 3), (7, 1), (100, 9)):
        got = stats.batches(spark.range(n), size, ["id"]).groupBy("batch").count().orderBy("batch").collect()
        assert [r[1] for r in got] == [len(x) for x in np.array_split(range(n), -(-n // size))]


def test_constant_sides_have_no_correlation(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "g int, x double, y double")
    got = {r.g: (r.spearman, r.pearson) for r in metrics.agreement(d, "x", "y", ["g"]).collect()}
    assert got[1] == (None, None) and got[2] == pytest.approx((1.0, 1.0))


def test_catalogue_agrees_with_sql(spark):
    import glob
    import os

    import duckdb

    from rootgraph.plans.catalog import QUERIES, SQL

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name in ("graph_orient", "wl_fingerprint", "path_fingerprint_cnt", "fold_general_modulus", "hexbin", "surrogate_ids", "tanimoto_search"):
        a = QUERIES[name](spark, sf).toPandas()
        b = con.execute(SQL[name]).df()[list(a.columns)]
        assert sorted(map(tuple, a.values.tolist()), key=repr) == sorted(map(tuple, b.values.tolist()), key=repr), name


def test_errors(spark):
    with pytest.raises(graph.GraphError):
        graph.refine(None, -1)
    with pytest.raises(graph.GraphError):
        graph.with_paths(None, 0)
    with pytest.raises(ValueError):
        bits.fold(F.lit("ab"), 0)
    for bad in ("", "CCO", "[Hg]C[Hg]", "[Hg].C", "[Hg]C("):
        with pytest.raises(smiles.StructureError):
            smiles.graph_of(bad)


def test_depths_and_labels_of_many_shapes(spark):
    """Trees, rings, level bonds, nodes out of reach and unusable roots, against breadth-first search; labels by hand."""
    import hashlib
    import random

    draw, rows = random.Random(4), []
    for g in range(40):
        n = draw.randint(1, 14)
        bonds = sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(draw.randint(0, 2 * n))}) if n > 1 else []
        rows.append((g, draw.randrange(n), [(i, i % 3) for i in range(n)], [(a, b, "SINGLE", (a + b) % 2 == 0) for a, b in bonds]))
    rows += [(40, None, [(0, 1), (1, 1)], [(0, 1, "SINGLE", False)]), (41, 7, [(0, 1)], []), (42, None, [], []), (43, None, None, None)]
    schema = "g int, root int, nodes array<struct<id:int,invariant:int>>, bonds array<struct<a:int,b:int,type:string,ring:boolean>>"
    got = {r.g: r for r in graph.refine(graph.with_depths(spark.createDataFrame(rows, schema)), 1, directed=False).collect()}
    for g, root, nodes, bonds in rows[:40]:
        far, front = {root: 0}, [root]
        while front:
            met = {b if a == i else a for i in front for a, b, *_ in bonds if i in (a, b)} - set(far)
            far |= dict.fromkeys(met, far[front[0]] + 1)
            front = sorted(met)
        assert got[g].depths == [far.get(i) for i in range(len(nodes))]
        for i, (_, own) in enumerate(nodes):
            seen = sorted(f"{t},{int(ring)},{nodes[b if a == i else a][1]}" for a, b, t, ring in bonds if i in (a, b))
            assert got[g].features[len(nodes) + i].label == hashlib.sha256(f"{own}|{';'.join(seen)}".encode()).hexdigest()
    assert got[40].depths == [None, None] and got[41].depths == [None] and got[42].depths == [] and got[43].depths is None


def test_as_many_pairs_as_asked(spark):
    ids = spark.range(10).toDF("ID")
    for asked, found in ((3, 3), (22, 22), (40, 40), (45, 45), (99, 45)):
        got = [(r.i, r.j) for r in similarity.sampled_pairs(ids, "ID", asked, 7).collect()]
        assert len(got) == len({tuple(sorted(p)) for p in got}) == found and all(i != j for i, j in got)


def test_pairs_meet_once_whatever_the_blocks(spark):
    d = spark.range(30).select("id", (F.col("id") % 2).alias("g"))
    for blocks in (1, 3, 7):
        got = [(r.id_i, r.id_j) for r in similarity.pairs(d.drop("g"), "id", blocks=blocks).collect()]
        assert sorted(got) == [(i, j) for i in range(30) for j in range(i + 1, 30)]
        got = [(r.id_i, r.id_j) for r in similarity.pairs(d, "id", ["g"], blocks).collect()]
        assert sorted(got) == [(i, j) for i in range(30) for j in range(i + 2, 30, 2)]


def test_classified_pairs_of_large_groups_are_dealt_in_blocks(spark):
    d = spark.range(60).select("id", F.when(F.col("id") != 7, F.col("id") % 2).alias("s"), (F.col("id") % 3).alias("p"), (F.col("id") % 5).alias("x"))
    whole, dealt = (similarity.classified_pairs(d, "id", "s", "p", "x", block) for block in (1000, 8))
    assert sorted(map(repr, dealt.select(*whole.columns).collect())) == sorted(map(repr, whole.collect()))
    assert dealt.rdd.getNumPartitions() >= 2 * (4 * 4 + 3 * 3)
