"""Job 2, incremental: keeps a library of directed-path descriptors of texts up to date as files arrive.

Each run takes the files that are new since the last one, reads their texts as chains of words, writes a descriptor for
each, and adds to the counts from which the density of the library is reported. Then it stops.

    python -m jobs.path_feed --config jobs/path_feed.json --set output=/data/feed checkpoint=/data/feed-checkpoint
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, told
from rootgraph.functions.texts import with_chain_bits
from rootgraph.sources.tables import blank


@dataclass(frozen=True)
class Config:
    #: a file or folder of Parquet files with doc_id, text, lang and source
    source: str
    output: str
    checkpoint: str
    n_bits: int = 1024
    max_edges: int = 3
    #: files in one micro-batch; all that are new if null
    files_at_once: int | None = None


#: texts in a task: a file of few bytes is much work, and may be one that cannot be split
ROWS = 1000
ROW = "doc_id bigint, source string, status string, n_words int, n_on int, on_bits array<int>, batch bigint, lang string"
PART = "source string, status string, n bigint, sum_on bigint, sum_on_squared bigint, batch bigint, lang string"


def described(texts: DataFrame, config: Config) -> DataFrame:
    """doc_id, source, status, n_words, n_on, on_bits, lang of each row; blank and wordless texts are kept, and say so."""
    rows = with_chain_bits(texts.select("doc_id", "source", "lang", "text"), "text", config.n_bits, config.max_edges)
    status = F.when(blank("text"), "blank").when(F.col("n_words") == 0, "no words").otherwise("ok")
    return rows.select("doc_id", "source", status.alias("status"), "n_words", F.size("on_bits").alias("n_on"), "on_bits", "lang")


def run(spark: SparkSession, config: Config) -> dict:
    """Takes what is new and returns what was read and written.

    The stream's checkpoint says which files are done. A micro-batch owns the partitions of its number, and writes them by
    dynamic overwrite, so one that is repeated after a failure replaces what it wrote before. Counts are kept for each
    batch, as sums; a report adds them up without reading descriptors again.
    """
    if config.files_at_once is not None and config.files_at_once < 1:
        raise ValueError("files_at_once is positive or null")
    done = {"batches": 0, "rows": 0}

    def take(batch: DataFrame, number: int) -> None:
        dealt = batch.repartition(max(1, -(-batch.count() // ROWS)), "doc_id", F.xxhash64("text"))
        rows = described(dealt, config).withColumn("batch", F.lit(number).cast("bigint"))
        _replace(rows, f"{config.output}/descriptors")
        kept = descriptors(spark, config.output).where(F.col("batch") == number)
        on = F.col("n_on").cast("bigint")
        parts = kept.groupBy("source", "status", "batch", "lang").agg(F.count("*").alias("n"), F.sum(on).alias("sum_on"), F.sum(on * on).alias("sum_on_squared"))
        _replace(parts.select("source", "status", "n", "sum_on", "sum_on_squared", "batch", "lang"), f"{config.output}/counts")
        n = counts(spark, config.output).where(F.col("batch") == number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        done.update(batches=done["batches"] + 1, rows=done["rows"] + n)
        told("path_feed batch", batch=number, rows=n, output=config.output)

    there = spark.read.parquet(config.source)
    reader = spark.readStream.schema(there.schema)
    if config.files_at_once:
        reader = reader.option("maxFilesPerTrigger", config.files_at_once)
    query = reader.parquet(_streamable(config.source, there.inputFiles())).writeStream.foreachBatch(take).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    told("path_feed", source=config.source, output=config.output, **done)
    return done


def _streamable(path: str, files: list[str]) -> str:
    """The path; if it is that of one file, as a pattern that only this path fits, as a stream takes folders and patterns only."""
    path = path.rstrip("/")
    name = path.rsplit("/", 1)[-1]
    return f"{path[:-1]}[{path[-1]}]" if len(files) == 1 and files[0].endswith(f"/{name}") else path


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang").parquet(path)


def descriptors(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(f"{output}/descriptors")


def counts(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(PART).parquet(f"{output}/counts")


def density(spark: SparkSession, output: str, n_bits: int) -> DataFrame:
    """(lang, source, n_structures, mean_on_bits, std_on_bits, mean_bit_density) of the sound texts of the whole library, from the counts."""
    n, total = F.sum("n"), F.sum("sum_on")
    spread = (F.sum("sum_on_squared") - total * total / n) / F.nullif(n - 1, F.lit(0))
    out = counts(spark, output).where("status = 'ok'").groupBy("lang", "source")
    return out.agg(n.alias("n_structures"), (total / n).alias("mean_on_bits"), F.sqrt(spread).alias("std_on_bits"), (total / n / n_bits).alias("mean_bit_density"))


if __name__ == "__main__":
    command("path_feed", Config, run)
