"""The analyses end to end on small libraries."""

import pytest
from pyspark.sql import functions as F

from rootgraph.plans import runners
from rootgraph.sources import tables

SMALL = runners.Config(n_bits=128, radius=2, max_edges=3, neighbor_k=(2,), batch_size=8, sample_size=5, bootstrap=20, ranking=3, n_pairs=10, topology_k=(1, 3), neighbor_ids=5, components=(1, 2))


def _csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def _written(spark, directory, results):
    """Every table has a folder with its header, and the metadata name the input's digest."""
    import hashlib
    import json

    assert {p.name for p in directory.iterdir()} == {*results, "run_metadata"}
    for name, df in results.items():
        assert spark.read.option("header", True).csv(str(directory / name)).columns == df.columns, name
    meta = json.loads(spark.read.text(str(directory / "run_metadata")).first()[0])
    assert meta["input"][0]["sha256"] == hashlib.sha256((directory.parent / "in.csv").read_bytes()).hexdigest()
    assert meta["parameters"]["n_bits"] in (64, 128)


def test_retention(spark, tmp_path):
    blocks = ["C", "CC", "CCC", "CCO", "CCN", "c1ccccc1"]
    path = _csv(tmp_path, "SMILES_BB,SMILES_0,SMILES_1\n" + "".join(f"[Hg]{b},[Hg]N{b},[Hg]C(=O){b}\n" for b in blocks))
    out = runners.run_retention(spark, path, SMALL, str(tmp_path / "out"))
    assert out["per_partner_metrics"].count() == 8
    assert out["molecule_manifest"].orderBy("source_row").first().bb_id == "BB_0001"
    with pytest.raises(FileExistsError):
        runners.run_retention(spark, path, SMALL, str(tmp_path / "out"))


def test_attachment(spark, tmp_path):
    rows = [("2", "c1cc([Hg])ncc1", "c1ccncc1"), ("3", "c1c([Hg])cncc1", "c1ccncc1"), ("2", "c1cc([Hg])oc1", "c1ccoc1"), ("3", "c1c([Hg])coc1", "c1ccoc1"), ("", "", "")]
    path = _csv(tmp_path, "Position,SMILES_Structure,SMILES_Scaffold\r\n" + "".join(",".join(r) + "\r\n" for r in rows))
    out = runners.run_attachment(spark, path, SMALL, str(tmp_path / "out"))
    _written(spark, tmp_path / "out", out)
    assert {r.pair_group: r.n for r in out["pairwise_comparison"].groupBy("pair_group").agg(F.count("*").alias("n")).collect()} == {"same_scaffold": 2, "same_position": 2}
    assert out["group_summary"].count() == 8
    top = out["ranked_rooted_wl_gain"].collect()
    assert 0 < len(top) <= 3 and all("[Hg]" in r.SMILES_Structure_i and r.SMILES_Scaffold_j for r in top)
    assert [r.rooted_wl_minus_reference for r in top] == sorted((r.rooted_wl_minus_reference for r in top), reverse=True)
    with pytest.raises(tables.TableError):
        tables.load_scaffolds(spark, _csv(tmp_path, "Position,SMILES_Structure,SMILES_Scaffold\n2,,x\n"))



def test_fingerprints_with_an_own_descriptor(spark):
    """A caller's descriptor stands beside the others; a structure that is no rooted graph is an error."""
    d = spark.createDataFrame([(1, "[Hg]CC"), (2, "[Hg]CCO")], "k int, s string")
    small = runners.Config(n_bits=128, radius=1, max_edges=2)
    size = lambda g, config: F.array(F.size("nodes") % config.n_bits)
    got = {(r.k, r.descriptor): r.on_bits for r in runners.fingerprints(d, ["k"], "s", small, extra={"size": size}).collect()}
    assert len(got) == 10 and got[1, "size"] == [3] and got[2, "size"] == [4]
    with pytest.raises(ValueError):
        runners.fingerprints(d, ["k"], "s", small, extra={"rooted_wl": size})
    with pytest.raises(Exception, match="marker|not a rooted graph"):
        runners.fingerprints(spark.createDataFrame([(1, "CC")], d.schema), ["k"], "s", small).collect()


def test_library(spark, tmp_path):
    """Two by three components; the caller's own descriptor goes through to the tables."""
    one, two = {"a": "CC", "b": "CCO"}, {"x": "N", "y": "NC", "z": "c1ccccc1"}
    lines = [f"{i},{j},[Hg]{p}C(=O){q},[Hg]{p},[Hg]{q}" for i, p in one.items() for j, q in two.items()]
    path = _csv(tmp_path, "BB1,BB2,SMILES_Product,SMILES_BB1,SMILES_BB2\n" + "\n".join(lines) + "\n")
    small = runners.Config(n_bits=64, radius=1, max_edges=2, neighbor_k=(2,), batch_size=6, sample_size=4)
    out = runners.run_library(spark, path, small, str(tmp_path / "out"), extra={"size": lambda g, c: F.array(F.size("nodes") % c.n_bits)})
    _written(spark, tmp_path / "out", out)
    got = out["per_batch_metrics"].collect()
    assert len(got) == 10 and {r.descriptor for r in got} == {*runners.DESCRIPTORS, "size"}
    assert all(r.n_pairs == 15 and r.n_products == 6 and 0 <= r.top_2_neighbor_preservation <= 1 and r.mae <= r.rmse + 1e-12 for r in got)
    assert out["dataset_summary"].first().complete and out["batch_manifest"].count() == 6
    assert out["mean_descriptor_differences"].count() == 8
    audit = {r.measure: r for r in out["batch_audit"].collect()}
    assert (audit["n_products"]["count"], audit["n_products"]["mean"], audit["unique_products"]["max"]) == (1, 6.0, 6.0)
    assert out["representative_pair_samples"].count() == 40  # 4 pairs, 5 descriptors, 2 means
    with pytest.raises(tables.TableError, match="combination"):
        tables.load_library(spark, _csv(tmp_path, "BB1,BB2,SMILES_Product,SMILES_BB1,SMILES_BB2\n" + "\n".join(lines[:-1]) + "\n"))


def test_topology(spark, tmp_path):
    """Matched structures with unrooted forms of their own, end to end, with an own descriptor."""
    columns = ("ID", "plain_1", "plain_2", "rooted_1", "rooted_2")
    tails = ["C", "CC", "CO", "CCN", "c1ccccc1"]
    lines = [f"m{k},CC{t},C(C){t}C,[Hg]CC{t},[Hg]C(C){t}" for k, t in enumerate(tails)]
    path = _csv(tmp_path, ",".join(columns) + "\n" + "\n".join(lines) + "\n")
    small = runners.Config(n_bits=64, radius=1, max_edges=2, n_pairs=6, topology_k=(1, 3), neighbor_ids=5, components=(1, 2), ranking=2)
    out = runners.run_topology(spark, path, columns, small, str(tmp_path / "out"), extra={"size": lambda g, c: F.array(F.size("nodes"))})
    _written(spark, tmp_path / "out", out)
    assert out["matched_pair_distances"].count() == 5 and out["matched_summary"].count() == 9
    assert out["controlled_pair_distances"].count() == 6 * 5
    assert out["topology_separation_summary"].count() == 5 and out["descriptor_comparison"].count() == 4
    assert out["pair_type_summary"].count() == 15 and out["pair_type_differences"].count() == 12
    asked = out["neighbor_query_results"].collect()
    assert len(asked) == 5 * 10 * 2 and all(r.effective_k == r.k for r in asked)
    assert out["population_component_summary"].agg(F.sum("n_assigned")).first()[0] == 5
    assert [r.ID for r in out["ranked_size_gain"].collect()] and "plain_1" in out["ranked_size_gain"].columns
    broken = _csv(tmp_path, ",".join(columns) + "\n" + "\n".join([*lines, "m9,C(C,CC,[Hg]C,[Hg]CC"]) + "\n")
    with pytest.raises(tables.TableError, match="row 7: unfinished"):
        tables.load_matched(spark, broken, columns)


def test_broken_structures_are_refused(spark, tmp_path):
    """Each column is read, the unrooted ones too; errors name the row, or come with the descriptors."""
    d = spark.createDataFrame([(1, "[Hg]CC", "C(C"), (2, "[Hg]CC", "CC")], "k int, s string, u string")
    small = runners.Config(n_bits=64, radius=1, max_edges=2)
    with pytest.raises(Exception, match="unfinished structure"):
        runners.fingerprints(d, ["k"], "s", small, "u").collect()
    good = runners.fingerprints(d.where("k = 2"), ["k"], "s", small, "u")
    assert {r.descriptor for r in good.collect()} == set(runners.DESCRIPTORS)
    assert good._jdf.queryExecution().toString().count("\n+- ArrowEvalPython") + good._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2
    scaffolds = "Position,SMILES_Structure,SMILES_Scaffold\n2,c1cc([Hg])ncc1,c1ccncc1\n3,c1c([Hg])cncc1,c1ccncc(\n"
    with pytest.raises(tables.TableError, match="row 3"):
        tables.load_scaffolds(spark, _csv(tmp_path, scaffolds))
    with pytest.raises(tables.TableError, match="row 2: unreadable"):
        tables.load_retention(spark, _csv(tmp_path, "SMILES_BB,SMILES_0\n[Hg]C?C,[Hg]C\n"))


def test_canonical_texts_are_exact_and_quick(spark):
    import random
    import time

    from rootgraph.functions.smiles import _order

    ring = "C1(C(F)(F)F)" + "C(C(F)(F)F)" * 6 + "C1C(F)(F)F"  # eight like groups on a ring
    same = [ring, "FC(F)(F)C1" + "C(C(F)(F)F)" * 7 + "1", "C1" + "(C(F)(F)F)C" * 7 + "1(C(F)(F)F)"]
    start = time.time()
    assert len({_order(s) for s in same}) == 1
    assert time.time() - start < 3 * 1.0  # tens of milliseconds each on an idle machine
    # five and more tied atoms that refinement cannot tell apart: rings of other sizes are other molecules
    parts, texts = ["C1CC1", "C1CCCCC1", "C1CCCC1", "C1CCC1"], set()
    for seed in range(6):
        random.Random(seed).shuffle(parts)
        texts.add(_order(".".join(parts)))
    assert len(texts) == 1
    assert _order("C1CCCCC1.C1CCCCC1") != _order("C1CCCCCCCCCCC1") != _order("C1CC1.C1CCCCCCCC1")
