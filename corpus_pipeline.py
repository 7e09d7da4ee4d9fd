"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootgraph.llm import decontaminate, language, lines, minhash, packing
from rootgraph.llm.common import columns, discard, fresh, table, written

#: SQL cannot express these stages; tests compare them with brute force
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language is undetermined; sets lang to the prediction.

    Each row is judged by its own text, so null and repeated ids change nothing: null, empty and letterless texts go,
    as do all rows if no language can be learned. Repeated rows stay repeated, very long texts are read whole, an
    empty table stays empty, and other columns of any name are kept.
    """
    lang, score = fresh(docs, "lang_pred", "score")
    out = language.with_language(docs, (lang, score)).where(F.col(lang) != language.UNKNOWN)
    return out.select(*(F.col(lang).alias("lang") if c == "lang" else col for c, col in zip(docs.columns, columns(docs), strict=True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every row stays, and n_chars follows the text.

    Null texts and rows with a null id are left as they are; a text that loses all its lines becomes empty; of equal
    lines the one in the smallest id stays; rows repeated with their id lose the same lines. Very long lines are
    compared whole. An empty table stays empty; other columns of any name are kept.
    """
    out = lines.dedup_lines(docs, counts=None)
    return out.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else col for c, col in zip(docs.columns, columns(out), strict=True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each class of near duplicates.

    Rows with a null text or a null id stay; empty texts are copies of each other, as are equal wordless ones. Ids are
    taken as unique: rows repeated with their id are one document and stay or go together. Very long texts are
    compared whole. An empty table stays empty; other columns of any name are kept.
    """
    return _without(docs, minhash.near_duplicates(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a passage of the benchmark.

    Null and empty texts hold none; rows with a null id stay. Rows repeated with their id go together. Whole texts
    are searched, of any length. An empty table or benchmark leaves all rows; other columns of any name are kept.
    """
    return _without(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows whose id is not among those found."""
    key = fresh(docs, "gone")[0]
    gone = found.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens; returns the pieces and their places.

    Null and empty texts are one piece of one token (the end of a document); texts of more than 2048 tokens are cut,
    repeated rows packed each. An empty table gives no rows; other columns do not matter.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table is deleted when its successor is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return docs
