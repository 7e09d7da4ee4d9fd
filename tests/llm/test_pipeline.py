"""The corpus pipeline, stage by stage, on awkward rows."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, docs, none, tmp_path):
    bench = spark.createDataFrame([(1, "w100 w101 w102 w103 w104 w105 w106 w107 w108 w109")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    at, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append((name, at.count(), {r.doc_id for r in at.select("doc_id").collect()}))
    kept = dict((n, ids) for n, _, ids in sizes)
    assert kept["language_id"] == {0, 1, 2, 7, 8, 9, 10, None}  # null, empty and letterless texts go
    assert kept["line_dedup"] == kept["language_id"]
    assert 0 in kept["near_dedup"] and not {1, 2} <= kept["near_dedup"]
    assert 8 not in kept["decontamination"] and {0, 7, 9, 10} <= kept["decontamination"]
    assert kept["best_fit_packing"] == kept["decontamination"]


def test_clashing_names(spark, docs, none, tmp_path):
    """Names the stages use themselves, as extra columns: kept with their values. Empty tables stay empty."""
    docs.sparkSession.createDataFrame([(1, "none of these words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["lang_pred", "score", "_id", "_gone", "n_lines", "n_removed", "at", "doc", "parts", "gone", "class_id", "kept", "contaminated", "n_hit", "f1", "place"]
    wide = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names), name
        assert stage(spark, wide.where("false"), str(tmp_path)).count() == 0


def test_language_is_judged_row_by_row(spark, docs):
    """A letterless text does not stay because another row of its id has letters."""
    rows = [(None, "some plain text", "en"), (None, "!!!", "en"), (1, "more plain text", "en"), (1, "???", "en")]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(r.text for r in got) == ["more plain text", "some plain text"]
