"""The jobs as registered queries, with DuckDB SQL for their output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import library_screen, path_feed
from rootgraph.functions.texts import WORD
from rootgraph.plans.fixtures import sql_signs, sql_tanimoto
from rootgraph.sources.shared import folder


def job1_library_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder: the second replaces what the first wrote."""
    config = library_screen.Config(f"{sf_dir}/embeddings.parquet", f"{folder(spark)}/job1-{uuid.uuid4().hex}")
    for _ in range(2):
        library_screen.run(spark, config)
    return library_screen.neighbours(spark, config.output)


def job2_path_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one checkpoint: the second finds nothing new."""
    at = f"{folder(spark)}/job2-{uuid.uuid4().hex}"
    config = path_feed.Config(f"{sf_dir}/documents.parquet", f"{at}/output", f"{at}/checkpoint")
    for _ in range(2):
        path_feed.run(spark, config)
    return path_feed.descriptors(spark, config.output).drop("batch")


QUERIES = {"job1_library_screen": job1_library_screen, "job2_path_feed": job2_path_feed}

_EDGES = ", ".join(
    [
        "h0 AS (SELECT *, list_prepend(sha256('''ROOT'''), list_transform(w, lambda x: sha256(x))) AS seed FROM d)",
        "h1 AS (SELECT *, list_transform(range(2, len(seed) + 1), lambda j: sha256(seed[j] || '|1|' || seed[j - 1])) AS p1 FROM h0)",
        *(f"h{e} AS (SELECT *, list_transform(range({e + 1}, len(seed) + 1), lambda j: sha256(p{e - 1}[j - {e - 1}] || '|1|' || seed[j - {e}])) AS p{e} FROM h{e - 1})" for e in (2, 3)),
    ]
)
SQL = {
    "job1_library_screen": "WITH "
    + sql_signs(w=(0, 64))
    + f""", s AS (SELECT a.vec_id AS query, b.vec_id AS match, {sql_tanimoto("a.w", "b.w")} AS similarity, len(a.w)::INT AS query_on, len(b.w)::INT AS match_on, a.label IS NOT DISTINCT FROM b.label AS same_class, a.label FROM f a JOIN f b ON a.vec_id <> b.vec_id)
SELECT query, rank, match, similarity, query_on, match_on, same_class, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, match)::INT AS rank FROM s) WHERE rank <= 10""",
    "job2_path_feed": f"""WITH d AS (SELECT doc_id, source, lang, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w FROM documents),
{_EDGES}, b AS (SELECT *, list_sort(list_distinct(list_transform(list_concat(p1, p2, p3), lambda h: (('0x' || right(h, 4))::BIGINT % 1024)::INT))) AS on_bits FROM h3)
SELECT doc_id, source, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' WHEN len(w) = 0 THEN 'no words' ELSE 'ok' END AS status, len(w)::INT AS n_words, len(on_bits)::INT AS n_on, on_bits, lang FROM b""",
}
