"""Rows of CSV files, matrices as blocks, pairs by a keyed permutation."""

import os

import pytest
from pyspark.sql import functions as F

from rootgraph.operators import similarity
from rootgraph.sources import tables


def test_source_rows_of_several_files_in_parts(spark, tmp_path):
    """Files of very different sizes, cut into parts that are scanned in another order than that of their names."""
    sizes, at, want = (3, 4000, 1, 700), 0, {}
    for k, n in enumerate(sizes):
        with open(tmp_path / f"part-{k}.csv", "w") as f:
            f.write("id,some text\n")
            for _ in range(n):
                f.write(f"{at},{'x' * (at % 40)}\n")
                want[str(at)] = at + 2
                at += 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tables.read_csv(spark, str(tmp_path))
        assert got.columns == ["id", "some text", "source_row"]
        assert {r.id: r.source_row for r in got.collect()} == want
        assert "Python" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(tables.TableError):
        tables.read_csv(spark, str(tmp_path), ["id"])


def test_matrix_round_trip_and_one_block(spark, tmp_path):
    ids = [f"m{i:02d}" for i in (5, 3, 11, 0, 8, 2, 7)]
    rows = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], "id string, at long")
    pairs = [(a, b, abs(i - j) / 7) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b]
    path = str(tmp_path / "matrix")
    assert tables.save_matrix(spark.createDataFrame(pairs, "i string, j string, s double"), rows, path, 3) == 3
    back = tables.read_matrix(spark, path)
    assert {(r.i, r.j, r.s, r.row, r.column) for r in back.collect()} == {(ids[i], ids[j], abs(i - j) / 7, i, j) for i in range(7) for j in range(i + 1, 7)}
    assert all((r.p, r.q) == (r.row // 3, r.column // 3) for r in back.collect())
    one = tables.read_matrix(spark, path, (0, 3), (3, 6), 3)
    assert sorted((r.row, r.column) for r in one.collect()) == [(i, j) for i in range(3) for j in range(3, 6)]
    files = {r[0].rsplit("/", 1)[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert {os.path.relpath(f.removeprefix("file://").removeprefix("file:"), path) for f in files} == {"p=0/q=1"}
    part = tables.read_matrix(spark, path, (2, 5), (4, 7), 3)
    assert sorted((r.row, r.column) for r in part.collect()) == [(i, j) for i in range(2, 5) for j in range(4, 7) if i < j]
    with pytest.raises(ValueError):
        tables.save_matrix(spark.createDataFrame(pairs, "i string, j string, s double"), rows, path, 0)


def test_permutation_and_places(spark):
    for side in (1, 2, 7, 30):
        got = [r[0] for r in spark.range(side * side).select(similarity.permuted(F.col("id"), side, 9)).collect()]
        assert sorted(got) == list(range(side * side))
    got = [(r[0], r[1]) for r in spark.range(45).select(*similarity.triangular(F.col("id"))).collect()]
    assert got == [(i, j) for j in range(10) for i in range(j)]
    for j in (2**31, 3 * 10**9 - 1):  # where doubles no longer hold the places
        t = j * (j - 1) // 2
        places = [(t - 1, (j - 2, j - 1)), (t, (0, j)), (t + j - 1, (j - 1, j)), (t + j, (0, j + 1))]
        got = spark.createDataFrame([(p,) for p, _ in places], "t long").select(*similarity.triangular(F.col("t"))).collect()
        assert [tuple(r) for r in got] == [w for _, w in places]


def test_rules_of_tables(spark):
    rows = spark.createDataFrame([(2, "[Hg]C", "a"), (3, "[Hg]C[Hg]", "a"), (4, "CC.[Hg]", "b"), (5, " ", "b")], "source_row long, s string, k string")
    with pytest.raises(tables.TableError, match="row 3: markers: 2; row 4: disconnected; row 5: empty"):
        tables.checked_structures(rows, ["s"])
    assert tables.checked_structures(rows.where("source_row = 2"), ["s"]).count() == 1
    with pytest.raises(tables.TableError, match="no rows"):
        tables.not_empty(rows.where("false"))
    with pytest.raises(tables.TableError, match="repeat"):
        tables.unique(rows, ["k"])
    with pytest.raises(tables.TableError, match="without a gap"):
        tables.numbered_columns(["SMILES_0", "SMILES_2"])
    assert tables.numbered_columns(["SMILES_10", "SMILES_BB", *(f"SMILES_{k}" for k in range(10))])[-1] == "SMILES_10"
    with pytest.raises(tables.TableError, match="missing columns"):
        tables.required_columns(["a"], ["a", "b"])
    many = spark.createDataFrame([(k, f"bad {k}") for k in range(2, 40)], "source_row long, e string")
    with pytest.raises(tables.TableError, match=r"row 2: bad 2; .*row 11: bad 11 \.\.\."):
        tables.report(many, "e")


def test_a_directory_in_use_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    tables.save(spark, {"t": df}, str(tmp_path / "out"), {"b": 1, "a": 2})
    assert spark.read.text(str(tmp_path / "out" / "run_metadata")).first()[0] == '{"a": 2, "b": 1}'
    with pytest.raises(FileExistsError):
        tables.save(spark, {"t": df}, str(tmp_path / "out"))
    assert tables.unused_directory(spark, str(tmp_path / "out")) == str(tmp_path / "out_2")
    tables.save(spark, {"t": df}, str(tmp_path / "out"), overwrite=True, kind="parquet", partitions={"t": ["y"]})
    assert spark.read.parquet(str(tmp_path / "out" / "t")).columns == ["x", "y"]
